"""Binary token shards as a Spark data source ("tokbin").

A shard is a header of 256 32-bit integers (magic, version, number of tokens, bits where they
aren't 16) and the tokens, all little-endian.  Reading splits a shard into ranges of tokens;
each partition seeks to its range and yields Arrow batches of (shard, position, token), or with
``layout=chunks`` rows of (shard, position, tokens); filters on shard and position leave out files and ranges, and
``readStream`` reads what has been added since the last batch.  Files are reached through ``pyarrow.fs``,
so local paths and the file systems it knows are read alike.

Writing takes rows (shard bigint, position bigint, tokens array<int>, and a folder below the path, if there is one) and writes one
file for each shard and task; deal the rows by shard and sort them first (``write_shards`` does).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    DataSourceStreamReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    LessThan,
    LessThanOrEqual,
    WriterCommitMessage,
)

# Fixed values of the format: header length in bytes; magic numbers of the 16-bit and the 32-bit form; version.
HEADER_BYTES = 1024
MAGIC_16, MAGIC_32 = 20240520, 20240930
VERSION = 1

RANGE_TOKENS = 1 << 22
CHUNK_TOKENS = 1 << 16
#: Of more ranges than ``FEW`` several may be one task's; to open a file counts as much as to read ``OPEN_TOKENS``.
FEW, OPEN_TOKENS = 64, 1 << 15


class BadShard(ValueError):
    pass


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def read_header(path: str) -> dict[str, int]:
    """Magic, bits and number of tokens, from the first kilobyte alone; checks them against the size."""
    system, name = _open(path)
    with system.open_input_file(name) as f:
        return _header(path, f)


def _header(path: str, f: pa.NativeFile) -> dict[str, int]:
    head = np.frombuffer(f.read_at(HEADER_BYTES, 0), "<i4")
    size = f.size()
    if len(head) < 4 or head[0] not in (MAGIC_16, MAGIC_32):
        raise BadShard(f"{path}: not a token shard")
    if head[1] != VERSION:
        raise BadShard(f"{path}: version {head[1]}")
    bits = 16 if head[0] == MAGIC_16 else 32
    if size != HEADER_BYTES + int(head[2]) * bits // 8:
        raise BadShard(f"{path}: the header says {head[2]} tokens, the size {(size - HEADER_BYTES) * 8 // bits}")
    return {"magic": int(head[0]), "bits": bits, "tokens": int(head[2])}


def header(n: int, bits: int) -> bytes:
    head = np.zeros(HEADER_BYTES // 4, "<i4")
    head[:3] = MAGIC_16 if bits == 16 else MAGIC_32, VERSION, n
    if bits != 16:
        head[3] = bits
    return head.tobytes()


def encode_shard(tokens: np.ndarray, bits: int = 16) -> bytes:
    tokens = np.asarray(tokens)
    if len(tokens) and (tokens.min() < 0 or tokens.max() >= 2**bits):
        raise BadShard(f"a token is outside 0 to 2**{bits} - 1")
    return header(len(tokens), bits) + tokens.astype(f"<u{bits // 8}").tobytes()


def shard_files(path: str, deep: bool = False) -> list[tuple[str, int]]:
    """(path, size) of a file, or of the *.bin files of a folder (``deep``: and of the folders in it), sorted by name; no file is opened."""
    system, name = _open(path)
    info = system.get_file_info(name)
    if info.type == fs.FileType.File:
        return [(path, info.size)]
    scheme = path.split("://")[0] + "://" if "://" in path else ""
    return sorted((scheme + f.path, f.size) for f in system.get_file_info(fs.FileSelector(name, recursive=deep)) if f.is_file and f.path.endswith(".bin"))


def list_shards(path: str) -> list[str]:
    return [f for f, _ in shard_files(path)]


class _Range(InputPartition):
    def __init__(self, path: str, bits: int, begin: int, end: int):
        super().__init__(None)
        self.path, self.bits, self.begin, self.end = path, bits, begin, end


class _Several(InputPartition):
    """Ranges that one task reads, one after the other."""

    def __init__(self, ranges: list[_Range]):
        super().__init__(None)
        self.bits, self.ranges = ranges[0].bits, [(r.path, r.begin, r.end) for r in ranges]


def _dealt(ranges: list[_Range], step: int) -> list[InputPartition]:
    """Neighbours together, so that the number of tasks follows the tokens, not the files: as many as make ``step`` tokens, and ``FEW`` tasks at least."""
    cost = [OPEN_TOKENS + r.end - r.begin for r in ranges]
    most, out, held, spent = min(max(step, OPEN_TOKENS), sum(cost) // FEW), [], [], 0
    if len(ranges) <= FEW:
        return ranges
    for r, c in zip(ranges, cost, strict=True):
        if held and spent + c > most:
            out.append(_Several(held))
            held, spent = [], 0
        held.append(r)
        spent += c
    return [*out, _Several(held)]


class _Ranges:
    """Ranges of tokens of the shards of a path, and how a task reads one."""

    def __init__(self, options: dict[str, str]):
        self.path, self.chunks = options["path"], options.get("layout", "tokens") == "chunks"
        self.deep = options.get("recursive", "false") == "true"
        self.length = int(options.get("chunkTokens", CHUNK_TOKENS))
        self.step = max(self.length, int(options.get("rangeTokens", RANGE_TOKENS)) // self.length * self.length)
        self.bits = int(options.get("bits", 16))  # ranges follow from the files' sizes; headers are read, and checked, by the tasks

    def sizes(self) -> list[tuple[str, int]]:
        return [(f, max(0, size - HEADER_BYTES) * 8 // self.bits) for f, size in shard_files(self.path, self.deep)]

    def cut(self, shard: str, begin: int, end: int) -> list[_Range]:
        return [_Range(shard, self.bits, a, min(a + self.step, end)) for a in range(begin, end, self.step)]

    def read(self, part: _Range | _Several) -> Iterator[pa.RecordBatch]:
        for path, begin, end in part.ranges if isinstance(part, _Several) else [(part.path, part.begin, part.end)]:
            if path:
                yield from self._read(path, part.bits, begin, end)

    def _read(self, path: str, bits: int, begin: int, end: int) -> Iterator[pa.RecordBatch]:
        width = bits // 8
        kind = pa.int32() if bits == 16 else pa.int64()
        system, name = _open(path)
        with system.open_input_file(name) as f:
            if _header(path, f)["bits"] != bits:
                raise BadShard(f"{path}: not of {bits} bits")
            for a in range(begin, end, self.length):
                b = min(a + self.length, end)
                found = np.frombuffer(f.read_at((b - a) * width, HEADER_BYTES + a * width), f"<u{width}")
                tokens = pa.array(found).cast(kind)
                if self.chunks:
                    lists = pa.ListArray.from_arrays(pa.array([0, b - a], pa.int32()), tokens)
                    yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([a], pa.int64()), lists], names=["shard", "position", "tokens"])
                else:
                    yield pa.RecordBatch.from_arrays([pa.repeat(path, b - a), pa.array(np.arange(a, b)), tokens], names=["shard", "position", "token"])


class TokenReader(_Ranges, DataSourceReader):
    """Reads shards as a table."""

    def __init__(self, options: dict[str, str]):
        super().__init__(options)
        self.low, self.high, self.shards = 0, None, None

    def partitions(self) -> list[InputPartition]:
        low = max(self.low, 0) // self.length * self.length  # chunks begin at multiples of their length, whatever is asked for
        found = []
        for shard, n in self.sizes():
            if self.shards is None or shard in self.shards:
                end = n if self.high is None else min(n, -(-self.high // self.length) * self.length if self.chunks else self.high)
                found += self.cut(shard, low, end) if n else [_Range(shard, self.bits, 0, 0)]
        return _dealt(found, self.step) or [_Range("", self.bits, 0, 0)]


class FilteredReader(TokenReader):
    """Comparisons of ``position`` and equalities of ``shard`` leave out the files and ranges that can't hold such rows; Spark
    applies them once more to the rows of what is left.

    Spark keeps what was pushed into a scan for later scans of the same table that push nothing, so this reader is only for tables that always push something
    (``read_shards`` sees to that)."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            column = getattr(f, "attribute", None)
            if column == ("position",) and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
                if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                    self.low = max(self.low, f.value + isinstance(f, GreaterThan))
                if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                    end = f.value + (not isinstance(f, LessThan))
                    self.high = end if self.high is None else min(self.high, end)
            elif column == ("shard",) and isinstance(f, (EqualTo, In)):
                own = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.shards = own if self.shards is None else self.shards & own
            yield f


class TokenStream(_Ranges, DataSourceStreamReader):
    """Reads shards as a stream: an offset tells for each shard how many of its tokens have been read, so a shard is read once, whatever
    is added between batches.

    With ``tokensPerBatch`` a batch takes so many tokens at most (whole chunks, shards in the order of their names); a query that goes on from a checkpoint
    takes all that has come meanwhile in its first batch, as Spark doesn't tell a reader where it stands before that."""

    def __init__(self, options: dict[str, str]):
        super().__init__(options)
        self.limit, self.known = int(options.get("tokensPerBatch", 0)), None

    def initialOffset(self) -> dict:  # noqa: N802
        self.known = {}
        return {}

    def latestOffset(self) -> dict:  # noqa: N802
        sizes = dict(self.sizes())
        if not self.limit or self.known is None:
            return sizes
        found, left = dict(self.known), max(self.limit // self.length * self.length, self.length)
        for shard, n in sizes.items():
            take = min(n - found.get(shard, 0), left)
            if take > 0:
                found[shard], left = found.get(shard, 0) + take, left - take
        return found

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        self.known = end
        return _dealt([x for shard, n in sorted(end.items()) for x in self.cut(shard, start.get(shard, 0), n)], self.step)


class _Written(WriterCommitMessage):
    def __init__(self, files: list[tuple[str, str]]):
        self.files = files


class TokenWriter(DataSourceArrowWriter):
    """Each task writes its shards under names of its own; the driver renames them when all is done.

    Rows come as Arrow batches, sorted by folder, shard and position, so a task holds one shard at a time."""

    def __init__(self, options: dict[str, str]):
        self.path, self.bits, self.prefix = options["path"].rstrip("/"), int(options.get("bits", 16)), options.get("prefix", "shard")

    def _save(self, folder: str, shard: int, pieces: list[np.ndarray]) -> tuple[str, str]:
        from pyspark import TaskContext

        system, base = _open("/".join(filter(None, (self.path, folder))))
        system.create_dir(base, recursive=True)
        name = f"{base}/_{self.prefix}_{shard:06d}.{TaskContext.get().taskAttemptId()}"
        with system.open_output_stream(name) as f:
            f.write(encode_shard(np.concatenate(pieces), self.bits))
        return name, f"{base}/{self.prefix}_{shard:06d}.bin"

    def write(self, batches: Iterator[pa.RecordBatch]) -> _Written:
        out: list[tuple[str, str]] = []
        now: tuple[str, int] | None = None
        held: list[np.ndarray] = []
        for batch in batches:
            folders = batch.column("folder").to_pylist() if "folder" in batch.schema.names else [""] * batch.num_rows
            lists = batch.column("tokens")
            values, at = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            for i, key in enumerate(zip(folders, batch.column("shard").to_pylist(), strict=True)):
                if key != now:
                    if held:
                        out.append(self._save(*now, held))
                    now, held = key, []
                held.append(values[at[i] : at[i + 1]])
        if held:
            out.append(self._save(*now, held))
        return _Written(out)

    def commit(self, messages: list[_Written]) -> None:
        system, _ = _open(self.path)
        for message in messages:
            for name, final in message.files if message else ():
                system.move(name, final)

    def abort(self, messages: list[_Written]) -> None:
        system, _ = _open(self.path)
        for message in messages:
            for name, _final in message.files if message else ():
                system.delete_file(name)


class TokenShards(DataSource):
    """Options: path; layout (tokens, chunks); bits (16, 32); rangeTokens; chunkTokens; recursive; prefix; filters (pushed); of streams tokensPerBatch."""

    @classmethod
    def name(cls) -> str:
        return "tokbin"

    def schema(self) -> str:
        wide = self.options.get("bits", "16") == "32"
        kind = "bigint" if wide else "int"
        return f"shard string, position bigint, tokens array<{kind}>" if self.options.get("layout") == "chunks" else f"shard string, position bigint, token {kind}"

    def reader(self, schema) -> TokenReader:
        kind = FilteredReader if self.options.get("filters") == "pushed" else TokenReader
        return kind(dict(self.options))

    def streamReader(self, schema) -> TokenStream:  # noqa: N802
        return TokenStream(dict(self.options))

    def writer(self, schema, overwrite: bool) -> TokenWriter:
        return TokenWriter(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(TokenShards)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def read_shards(spark: SparkSession, path: str, bits: int = 16, layout: str = "tokens", recursive: bool = False) -> DataFrame:
    register(spark)
    rows = spark.read.format("tokbin").options(path=path, bits=str(bits), layout=layout, recursive=str(recursive).lower(), filters="pushed").load()
    return rows.filter("position >= 0")  # true of all rows; see FilteredReader


def stream_shards(spark: SparkSession, path: str, bits: int = 16, layout: str = "tokens", tokens_per_batch: int = 0) -> DataFrame:
    """A stream of the shards that are put into a folder."""
    register(spark)
    return spark.readStream.format("tokbin").options(path=path, bits=str(bits), layout=layout, tokensPerBatch=str(tokens_per_batch)).load()


def write_shards(pieces: DataFrame, path: str, bits: int = 16, prefix: str = "shard", tokens: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """``pieces``: (shard, position, tokens), and a ``folder`` below the path, if there is one; a shard's rows meet in one task, and a
    shard is bounded by its size.  ``tokens`` adds the column of that name to rows that have met, in their order, where something smaller can be shuffled."""
    register(pieces.sparkSession)
    keys = ["folder", "shard"] if "folder" in pieces.columns else ["shard"]
    kind = "array<int>" if bits == 16 else "array<bigint>"
    met = pieces.withColumns({"shard": F.col("shard").cast("bigint"), "position": F.col("position").cast("bigint")}).repartition(*keys).sortWithinPartitions(*keys, "position")
    rows = (tokens(met) if tokens else met).select(*keys, "position", F.col("tokens").cast(kind).alias("tokens"))
    rows.write.format("tokbin").options(path=path, bits=str(bits), prefix=prefix).mode("append").save()


def build_pools(docs: DataFrame, path: str, target: int, shard_tokens: int, pool: str = "pool", key: str = "doc_id", bits: int = 16) -> DataFrame:
    """Write the shards of many pools at once and return their manifest: (name, docs, tokens, shards, target, done).

    ``docs``: (pool, key, ids), ids with the document's start; a pool takes documents in order until it has ``target`` tokens, and its stream is
    cut into shards below <path>/<pool>."""
    from corpusmill.operators.corpus import cap_budget, shard_slices
    from corpusmill.sources.sinks import manifest

    sizes = docs.select(pool, key, F.size("ids").cast("bigint").alias("n_tokens"))
    kept = cap_budget(sizes, pool, key, "n_tokens", target)
    pieces = shard_slices(kept, shard_tokens, key, by=pool).join(docs.select(pool, key, "ids"), [pool, key])
    tokens = F.slice("ids", (F.col("begin") + 1).cast("int"), F.col("length").cast("int"))
    write_shards(pieces.select(F.col(pool).alias("folder"), "shard", "position", tokens.alias("tokens")), path, bits)
    return manifest(kept, pool, "n_tokens", shard_tokens, target)


def count_tokens(spark: SparkSession, paths: DataFrame) -> DataFrame:
    """(path, bits, tokens) by header alone, for a table of paths."""

    def peek(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [read_header(p) for p in batch.column("path").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array([x["bits"] for x in found], pa.int32()), pa.array([x["tokens"] for x in found], pa.int64())], names=["path", "bits", "tokens"])

    return paths.select("path").mapInArrow(peek, "path string, bits int, tokens bigint")
