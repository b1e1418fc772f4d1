"""Binary alignment files: a data source that reads them in splits, and a sink of parts.

The file is a run of gzip members of at most 64 KB (BGZF) whose inflated bytes are a header and then records, which cross
members freely. A split owns the records that begin in members that begin inside it. Only the first split knows where its
first record is; the others look for a member and then for a place from which a chain of records holds. Each split also
looks for the first record of the next one and compares it with where its own chain of records ends, so that a wrong
guess stops the job and no record is lost or read twice.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from tessera.operators.rounds import settled


# Fixed values of the public format.
MEMBER = b"\x1f\x8b\x08\x04"
LAST_MEMBER = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
FILE_MAGIC = b"BAM\x01"
LETTERS = "=ACMGRSVTWYHKDBN"
OPERATIONS = "MIDNSHP=X"
TAG_NUMBERS = {"c": "b", "C": "B", "s": "h", "S": "H", "i": "i", "I": "I", "f": "f"}
BINS = ((14, 4681), (17, 585), (20, 73), (23, 9), (26, 1))
MOST = 65536
FIXED = struct.Struct("<iiiBBHHHiiii")  # size, reference, position, name length, mapping quality, bin, operations, flag, bases, next reference, next position, template length

TO_LETTERS = str.maketrans("0123456789abcdef", LETTERS)
# Each base as the hexadecimal digit of its code, other characters as N.
FROM_LETTERS = bytes(b"0123456789abcdef"[LETTERS.find(chr(i))] for i in range(256))
NAMES = bytes(range(33, 127))
LOW = bytes(i & 15 for i in range(256))
TO_QUALITY = bytes(min(i + 33, 126) for i in range(256))
FROM_QUALITY = bytes(max(i - 33, 0) for i in range(256))

#: Columns that a scan can give; those of `scans.sam` come by default.
COLUMNS = {"name": "string", "flag": "int", "chrom": "string", "pos": "bigint", "mapq": "int", "cigar": "string", "seq": "string", "tags": "map<string,string>", "next_chrom": "string", "next_pos": "bigint", "length": "int", "qual": "string", "ref": "int", "record": "binary", "spans": "struct<ref_consumed:int,query_aligned:int>"}
ARROW = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary(), "map<string,string>": pa.map_(pa.string(), pa.string()), "struct<ref_consumed:int,query_aligned:int>": pa.struct([("ref_consumed", pa.int32()), ("query_aligned", pa.int32())])}
USUAL = ("name", "flag", "chrom", "pos", "mapq", "cigar", "seq", "tags")
#: Records that have to follow one another from a place taken for a record's start.
CHAIN = 12
BATCH = 4096


def _open(path: str):
    files, inner = pafs.FileSystem.from_uri(path)
    return files, inner


class _Bytes:
    """A file's bytes by offset, fetched in pieces."""

    def __init__(self, files, path: str, size: int, piece: int = 1 << 21):
        self.file, self.size, self.piece, self.at, self.held = files.open_input_file(path), size, piece, 0, b""

    def get(self, at: int, n: int) -> bytes:
        n = min(n, self.size - at)
        if at < self.at or at + n > self.at + len(self.held):
            self.at, self.held = at, self.file.read_at(max(n, min(self.piece, self.size - at)), at)
        return self.held[at - self.at : at - self.at + n]


def _member(source: _Bytes, at: int) -> tuple[int, bytes]:
    """Compressed size and inflated bytes of the member at an offset; ValueError where none is."""
    b = source.get(at, MOST)
    if b[:4] != MEMBER or len(b) < 26:
        raise ValueError(f"no member at {at}")
    extra = 12 + int.from_bytes(b[10:12], "little")
    p, size = 12, 0
    while p + 4 <= extra:
        if b[p : p + 2] == b"BC":
            size = int.from_bytes(b[p + 4 : p + 6], "little") + 1
        p += 4 + int.from_bytes(b[p + 2 : p + 4], "little")
    if not extra + 8 < size <= len(b):
        raise ValueError(f"no member at {at}")
    try:
        data = zlib.decompress(b[extra : size - 8], -15)
    except zlib.error as e:
        raise ValueError(f"no member at {at}") from e
    if (zlib.crc32(data), len(data)) != struct.unpack_from("<II", b, size - 8):
        raise ValueError(f"damaged member at {at}")
    return size, data


def _next_member(source: _Bytes, at: int) -> int:
    """Offset of the first member at or after an offset; the file's size where none is."""
    if at >= source.size:
        return source.size
    near, i = source.get(at, 2 * MOST), -1
    while (i := near.find(MEMBER, i + 1)) >= 0:
        try:
            _member(source, at + i)
            return at + i
        except ValueError:
            continue
    if at + len(near) < source.size:
        raise ValueError(f"no member within {len(near)} bytes of {at}")
    return source.size


class _Inflated:
    """Inflated bytes from a member on. `here` is the offset in `held` of the next record; what lies before it is let go."""

    def __init__(self, source: _Bytes, at: int):
        self.source, self.next, self.held, self.base, self.here, self.starts, self.members = source, at, bytearray(), 0, 0, [], []

    def has(self, upto: int) -> bool:
        while len(self.held) < upto and self.next < self.source.size:
            size, data = _member(self.source, self.next)
            if data:
                self.starts.append(self.base + len(self.held))
                self.members.append(self.next)
                self.held += data
            self.next += size
        return len(self.held) >= upto

    def place(self, i: int) -> tuple[int, int]:
        """(member's offset, offset inside it) of a byte of `held`; (file's size, 0) past the last."""
        if not self.has(i + 1):
            return self.source.size, 0
        k = bisect_right(self.starts, self.base + i) - 1
        return self.members[k], self.base + i - self.starts[k]

    def drop(self) -> None:
        if self.here > 1 << 22:
            del self.held[: self.here]
            self.base, self.here = self.base + self.here, 0
            k = max(0, bisect_right(self.starts, self.base) - 1)
            del self.starts[:k], self.members[:k]


@dataclass
class Header:
    text: str
    references: list[tuple[str, int]]
    first: tuple[int, int]


def _header(source: _Bytes) -> Header:
    s = _Inflated(source, 0)

    def take(n: int) -> bytes:
        if not s.has(s.here + n):
            raise ValueError("the file ends inside its header")
        s.here += n
        return bytes(s.held[s.here - n : s.here])

    if take(4) != FILE_MAGIC:
        raise ValueError("not an alignment file")
    number = lambda: int.from_bytes(take(4), "little", signed=True)
    text = take(number()).rstrip(b"\0").decode()
    refs = [(take(number())[:-1].decode(), number()) for _ in range(number())]
    return Header(text, refs, s.place(s.here))


def _record_at(s: _Inflated, i: int, references: int) -> int:
    """Whole length of the record that can begin at byte i; 0 where none can, -1 at the file's end."""
    if not s.has(i + 36):
        return -1 if len(s.held) == i else 0
    size, ref, pos, name, _, _, ops, _, bases, other, other_pos, _ = FIXED.unpack_from(s.held, i)
    if not (-1 <= ref < references and -1 <= other < references and pos >= -1 and other_pos >= -1 and name >= 1 and bases >= 0):
        return 0
    if size < 32 + name + 4 * ops + (bases + 1) // 2 + bases or not s.has(i + 36 + name):
        return 0
    text = s.held[i + 36 : i + 35 + name]
    if s.held[i + 35 + name] or text.translate(None, NAMES) or not s.has(i + 36 + name + 4 * ops):
        return 0
    if ops and max(s.held[i + 36 + name : i + 36 + name + 4 * ops : 4].translate(LOW)) > 8:
        return 0
    return 4 + size


def _chained(s: _Inflated, i: int, references: int) -> bool:
    for _ in range(CHAIN):
        n = _record_at(s, i, references)
        if n <= 0:
            return n < 0
        if not s.has(i + n):
            return False
        i += n
    return True


def _from(source: _Bytes, header: Header, at: int) -> _Inflated | None:
    """The bytes from the first record on that begins in a member at or after an offset; None past the last."""
    if at <= header.first[0]:
        if header.first[0] >= source.size:
            return None
        s = _Inflated(source, header.first[0])
        s.here = header.first[1]
        return s
    s, i = _Inflated(source, _next_member(source, at)), 0
    while s.has(i + 1):
        if _chained(s, i, len(header.references)):
            s.here = i
            return s
        i += 1
    return None


@lru_cache(1 << 12)
def _cigar(raw: bytes) -> str:
    return "".join(f"{v >> 4}{OPERATIONS[v & 15]}" for v in struct.unpack(f"<{len(raw) // 4}I", raw)) or "*"


@lru_cache(1 << 12)
def _spans(cigar: str) -> tuple[int, int]:
    """Bases of the reference and of the read that a CIGAR aligns, as `cigar_spans` counts them."""
    ops = _operations(cigar)
    total = lambda kinds: sum(v >> 4 for v in ops if OPERATIONS[v & 15] in kinds)
    return total("MDN=X"), total("MI=X")


def _tags(raw: bytes) -> dict[str, str]:
    """Tags as their text in SAM, without name and type."""
    out, p = {}, 0
    while p < len(raw):
        name, kind = raw[p : p + 2].decode(), chr(raw[p + 2])
        p += 3
        if kind in "ZH":
            end = raw.index(0, p)
            value, p = raw[p:end].decode(), end + 1
        elif kind == "A":
            value, p = chr(raw[p]), p + 1
        elif kind == "B":
            sub, n = chr(raw[p]), int.from_bytes(raw[p + 1 : p + 5], "little")
            shape = struct.Struct(f"<{n}{TAG_NUMBERS[sub]}")
            value = ",".join([sub, *(_number(x) for x in shape.unpack_from(raw, p + 5))])
            p += 5 + shape.size
        else:
            shape = struct.Struct("<" + TAG_NUMBERS[kind])
            value, p = _number(shape.unpack_from(raw, p)[0]), p + shape.size
        out[name] = value
    return out


def _number(x) -> str:
    return f"{x:g}" if isinstance(x, float) else str(x)


def _decoder(columns: Sequence[str], names: list[str]):
    """A record's bytes to its wanted columns, as a tuple; only what is asked for is decoded."""
    ref_name = lambda i: names[i] if i >= 0 else "*"
    wanted = set(columns)

    def decode(b: bytes) -> tuple:
        _, ref, pos, ln, mapq, _, ops, flag, bases, other, other_pos, length = FIXED.unpack_from(b)
        c = 36 + ln
        q = c + 4 * ops
        u = q + (bases + 1) // 2
        v = u + bases
        row = {"flag": flag, "pos": pos + 1, "mapq": mapq, "next_pos": other_pos + 1, "length": length, "ref": ref, "record": b}
        if "name" in wanted:
            row["name"] = b[36 : c - 1].decode()
        if "chrom" in wanted:
            row["chrom"] = ref_name(ref)
        if "next_chrom" in wanted:
            row["next_chrom"] = "=" if other == ref >= 0 else ref_name(other)
        if "seq" in wanted:
            row["seq"] = b[q:u].hex().translate(TO_LETTERS)[:bases] or "*"
        if "qual" in wanted:
            row["qual"] = b[u:v].translate(TO_QUALITY).decode() if bases and b[u] != 255 else "*"
        if "tags" in wanted or "cigar" in wanted or "spans" in wanted:
            # More than 65535 operations stand in a tag, behind two that only name the lengths.
            away = ops == 2 and int.from_bytes(b[c : c + 4], "little") == (bases << 4 | 4)
            tags = _tags(b[v:]) if away or "tags" in wanted else {}
            long = tags.pop("CG", None) if away else None
            row["tags"] = list(tags.items())
            row["cigar"] = _cigar(b[c:q]) if long is None else _cigar(struct.pack(f"<{long.count(',')}I", *map(int, long.split(",")[1:])))
            if "spans" in wanted:
                row["spans"] = _spans(row["cigar"])
        return tuple(row[k] for k in columns)

    return decode


@dataclass
class Split(InputPartition):
    path: str
    start: int
    end: int
    size: int


def _files(path: str) -> list:
    files, inner = _open(path)
    info = files.get_file_info(inner)
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == pafs.FileType.File:
        return [(path, info.size)]
    scheme = path[: path.index(inner)] if inner in path else ""
    found = files.get_file_info(pafs.FileSelector(inner, recursive=False))
    return sorted((scheme + x.path, x.size) for x in found if x.type == pafs.FileType.File and x.base_name.endswith(".bam") and x.base_name[0] not in "._")


class Reader(DataSourceReader):
    def __init__(self, options: dict, columns: list[str]):
        self.path, self.columns = options["path"], columns
        self.step = int(options.get("split_bytes", 1 << 26))
        self.chroms = set(options["chroms"].split(",")) if options.get("chroms") else None
        self.least, self.off = int(options.get("min_mapq", 0)), int(options.get("off_flags", 0))

    def partitions(self) -> list[Split]:
        return [Split(p, a, min(a + self.step, n), n) for p, n in _files(self.path) for a in range(0, n, self.step)]

    def read(self, split: Split) -> Iterator[pa.RecordBatch]:
        files, inner = _open(split.path)
        source = _Bytes(files, inner, split.size, min(1 << 21, split.end - split.start + 2 * MOST))
        header = _header(source)
        names = [n for n, _ in header.references]
        refs = None if self.chroms is None else {i for i, n in enumerate(names) if n in self.chroms} | ({-1} if "*" in self.chroms else set())
        schema = pa.schema([(c, ARROW[COLUMNS[c]]) for c in self.columns])
        decode, rows = _decoder(self.columns, names), []
        s = _from(source, header, split.start)
        place = s.place(s.here) if s else (split.size, 0)
        while place[0] < split.end:
            n = _record_at(s, s.here, len(names))
            if n <= 0 or not s.has(s.here + n):
                raise ValueError(f"{split.path}: no whole record at member {place[0]}, byte {place[1]}")
            _, ref, _, _, mapq, _, _, flag, *_ = FIXED.unpack_from(s.held, s.here)
            if mapq >= self.least and not flag & self.off and (refs is None or ref in refs):
                rows.append(decode(bytes(s.held[s.here : s.here + n])))
                if len(rows) >= BATCH:
                    yield _batch(rows, schema)
                    rows = []
            s.here += n
            s.drop()
            place = s.place(s.here)
        if split.end < split.size:
            after = _from(source, header, split.end)
            if (after.place(after.here) if after else (split.size, 0)) != place:
                raise ValueError(f"{split.path}: the first record behind byte {split.end} is not where the records before it end")
        if rows:
            yield _batch(rows, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


@dataclass
class Part(WriterCommitMessage):
    name: str


def _packed(data: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = z.compress(data) + z.flush()
    return MEMBER + b"\0\0\0\0\0\xff\x06\0BC\x02\0" + struct.pack("<H", len(body) + 25) + body + struct.pack("<II", zlib.crc32(data), len(data))


def header_bytes(text: str, references: Sequence[tuple[str, int]]) -> bytes:
    t = text.encode()
    out = [FILE_MAGIC, struct.pack("<i", len(t)), t, struct.pack("<i", len(references))]
    for name, length in references:
        n = name.encode() + b"\0"
        out += [struct.pack("<i", len(n)), n, struct.pack("<i", length)]
    return b"".join(out)


class Writer(DataSourceArrowWriter):
    """A part per task under a name of its own; the driver moves the parts of the attempts that count into place."""

    def __init__(self, options: dict, column: int):
        self.path, self.header, self.column = options["path"], bytes.fromhex(options["header"]), column

    def write(self, batches: Iterator[pa.RecordBatch]) -> Part:
        from pyspark import TaskContext

        files, inner = _open(self.path)
        files.create_dir(f"{inner}/_temporary", recursive=True)
        name = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.bam"
        with files.open_output_stream(f"{inner}/_temporary/{name}", compression=None) as out:
            held = bytearray(self.header)
            for batch in batches:
                records = batch.column(self.column)
                if records.null_count:
                    raise ValueError("a record is null")
                records = records.cast(pa.large_binary())
                ends = np.frombuffer(records.buffers()[1], np.int64, len(records) + 1, 8 * records.offset) if len(records) else (0, 0)
                held += memoryview(records.buffers()[2] or b"")[ends[0] : ends[-1]]
                at = 0
                while len(held) - at >= MOST - 1024:
                    out.write(_packed(bytes(held[at : at + MOST - 1024])))
                    at += MOST - 1024
                del held[:at]
            for i in range(0, len(held), MOST - 1024):
                out.write(_packed(bytes(held[i : i + MOST - 1024])))
            out.write(LAST_MEMBER)
        return Part(name)

    def commit(self, messages: list[Part | None]) -> None:
        files, inner = _open(self.path)
        for m in messages:
            if m is not None:
                files.move(f"{inner}/_temporary/{m.name}", f"{inner}/{m.name}")
        if files.get_file_info(f"{inner}/_temporary").type != pafs.FileType.NotFound:
            files.delete_dir(f"{inner}/_temporary")
        with files.open_output_stream(f"{inner}/_SUCCESS"):
            pass

    def abort(self, messages: list[Part | None]) -> None:
        files, inner = _open(self.path)
        if files.get_file_info(f"{inner}/_temporary").type != pafs.FileType.NotFound:
            files.delete_dir(f"{inner}/_temporary")


class Alignments(DataSource):
    @classmethod
    def name(cls) -> str:
        return "alignments"

    def _columns(self) -> list[str]:
        return self.options.get("columns", ",".join(USUAL)).split(",")

    def schema(self) -> str:
        return ", ".join(f"`{c}` {COLUMNS[c]}" for c in self._columns())

    def reader(self, schema: StructType) -> Reader:
        return Reader(dict(self.options), self._columns())

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        return Writer(dict(self.options), schema.names.index("record"))


def bam(spark: SparkSession, path: str, columns: Sequence[str] | None = None, chroms: Sequence[str] = (), min_mapq: int = 0, off_flags: int = 0, split_bytes: int = 1 << 26) -> DataFrame:
    """Alignments of a file or of a folder's .bam files, in the form of `scans.sam`; or the named columns of COLUMNS alone.

    Only the columns asked for are decoded. `chroms`, `min_mapq` and `off_flags` (none of these bits may be set) are
    tested on a record's fixed fields, before it is decoded. Spans come with the default columns, or by name."""
    spark.dataSource.register(Alignments)
    reader = spark.read.format("alignments").option("split_bytes", split_bytes).option("min_mapq", min_mapq).option("off_flags", off_flags)
    if chroms:
        reader = reader.option("chroms", ",".join(chroms))
    return reader.option("columns", ",".join(columns or (*USUAL, "spans"))).load(path)


def header(path: str) -> Header:
    """Text and references that all files of a path share; files that differ in references raise, as their records do not mix."""
    found = None
    for p, size in _files(path):
        files, inner = _open(p)
        h = _header(_Bytes(files, inner, size, MOST * 2))
        if found is not None and h.references != found.references:
            raise ValueError(f"{p} has other references than the files before it")
        found = found or h
    if found is None:
        raise FileNotFoundError(f"no .bam file in {path}")
    return found


def write_bam(df: DataFrame, path: str, references: Sequence[tuple[str, int]], text: str = "@HD\tVN:1.6\n") -> None:
    """Writes the records of column `record`, one file a partition, in the partition's order. The folder must be new."""
    files, inner = _open(path)
    if files.get_file_info(inner).type != pafs.FileType.NotFound:
        raise FileExistsError(path)
    df.sparkSession.dataSource.register(Alignments)
    df.select("record").write.format("alignments").option("header", header_bytes(text, references).hex()).mode("append").save(path)


@lru_cache(1 << 12)
def _operations(cigar: str) -> list[int]:
    out, n = [], 0
    for c in "" if cigar == "*" else cigar:
        if c.isdigit():
            n = 10 * n + int(c)
        else:
            out.append(n << 4 | OPERATIONS.index(c))
            n = 0
    return out


def _tag_bytes(name: str, value: str, kind: str) -> bytes:
    head = name.encode() + kind.encode()
    if kind == "i":
        return head + struct.pack("<i", int(value))
    if kind == "f":
        return head + struct.pack("<f", float(value))
    if kind == "A":
        return head + value.encode()[:1]
    if kind == "B":
        sub, *numbers = value.split(",")
        return head + sub.encode() + struct.pack(f"<I{len(numbers)}{TAG_NUMBERS[sub]}", len(numbers), *(float(x) if sub == "f" else int(x) for x in numbers))
    return head + value.encode() + b"\0"


def _encoded(row: dict, places: dict[str, int], kinds: dict[str, str]) -> bytes:
    name, ops, seq = row["name"].encode() + b"\0", _operations(row["cigar"]), "" if row["seq"] == "*" else row["seq"]
    ref, start = places[row["chrom"]], row["pos"] - 1
    end = start + max(1, sum(v >> 4 for v in ops if v & 15 in (0, 2, 3, 7, 8)))
    bin_ = next((first + (start >> shift) for shift, first in BINS if start >> shift == (end - 1) >> shift), 0) if start >= 0 else 4680
    tags = b"".join(_tag_bytes(k, v, kinds.get(k, "Z")) for k, v in row["tags"] or ())
    if len(ops) > 65535:
        tags += b"CGBI" + struct.pack(f"<I{len(ops)}I", len(ops), *ops)
        ops = [len(seq) << 4 | 4, (end - start) << 4 | 3]
    codes = bytes.fromhex((seq.upper().encode("latin-1", "replace").translate(FROM_LETTERS) + b"0" * (len(seq) % 2)).decode())
    qual = row.get("qual") or "*"
    quality = b"\xff" * len(seq) if qual == "*" else qual.encode().translate(FROM_QUALITY)
    if len(quality) != len(seq) or len(name) > 255:
        raise ValueError(f"{row['name']}: qualities and bases differ in number, or the name is too long")
    other = row.get("next_chrom") or "*"
    body = name + struct.pack(f"<{len(ops)}I", *ops) + codes + quality + tags
    return FIXED.pack(32 + len(body), ref, start, len(name), row["mapq"], bin_ & 0xFFFF, len(ops), row["flag"], len(seq), ref if other == "=" else places[other], (row.get("next_pos") or 0) - 1, row.get("length") or 0) + body


def _listed(column: pa.Array) -> list:
    if not pa.types.is_map(column.type):
        return column.to_pylist()
    pairs = list(zip(column.keys.to_pylist(), column.items.to_pylist(), strict=True))
    ends = column.offsets.to_pylist()
    return [pairs[a:b] for a, b in zip(ends, ends[1:], strict=False)]


def encoded(df: DataFrame, references: Sequence[tuple[str, int]], kinds: dict[str, str] | None = None, alone: bool = False) -> DataFrame:
    """Adds `record` to rows in the form of `scans.sam` (with qual, next_chrom, next_pos and length where they are there).

    kinds: SAM types of tags, Z where not named. A chromosome outside the references raises. `alone`: the other columns go,
    which spares their way back from Python."""
    places = {n: i for i, (n, _) in enumerate(references)} | {"*": -1}
    used = [c for c in COLUMNS if c in df.columns and c not in ("ref", "record", "spans")]

    def encode(batches):
        for batch in batches:
            # Column by column, maps by their flat keys and values: rows as dictionaries of lists cost more than the encoding.
            columns = [_listed(batch.column(c)) for c in used]
            rows = (dict(zip(used, r, strict=True)) for r in zip(*columns, strict=True))
            kept = ([], []) if alone else (batch.columns, batch.schema.names)
            yield pa.RecordBatch.from_arrays([*kept[0], pa.array([_encoded(r, places, kinds or {}) for r in rows], pa.binary())], names=[*kept[1], "record"])

    return df.mapInArrow(encode, StructType([] if alone else [*df.schema.fields]).add("record", "binary"))


def keep_tagged(spark: SparkSession, source: str, target: str, values: DataFrame, column: str, tag: str = "CB", split_bytes: int = 1 << 26) -> None:
    """Writes the alignments whose tag is among the values to a new folder, unchanged, in order of reference and position.

    The values may grow with the data: they are joined, not broadcast by hand. Records pass as bytes, so that nothing of
    them is lost; unmapped ones come last."""
    h = header(source)
    rows = bam(spark, source, ("ref", "pos", "name", "flag", "tags", "record"), split_bytes=split_bytes).withColumn("__tag", F.try_element_at("tags", F.lit(tag)))
    kept = rows.join(values.select(F.col(column).cast("string").alias("__tag")).distinct(), "__tag", "left_semi")
    order = [(F.col("ref") < 0).alias("__last"), "ref", "pos", "name", "flag"]
    # Written once: the ranges are found by a pass of their own, which would else decode the whole file a second time.
    sorted_rows = settled(kept.select(order[0], *order[1:], "record")).repartitionByRange("__last", "ref", "pos", "name", "flag").sortWithinPartitions("__last", "ref", "pos", "name", "flag")
    write_bam(sorted_rows, target, h.references, h.text)
