"""Far too many small files: indexed archive containers.

Small files are packed, byte for byte, into large block files; an index keeps path, block, offset, length and checksum
of every member. `store` writes a block as its members come, in order, so it never holds one; `lookup` reads members by
their ranges and nothing else, blocks in parallel. The index also has a digest of every record, from which it follows which files add nothing: a file all of
whose records are in one earlier live file is left out.

Skew: a record that is in very many files costs one row per file and is aggregated on the map side; files with the
same set of records are represented by the first of them, so copies are never paired with each other. A file is
compared only with files that share its rarest record. No pairs within a group, no broadcast beyond Spark's own check.

Defined results: equality of records is over all named columns, null equal to null, by a digest of 128 bits (two
independent 64-bit hashes). A file without records isn't live. Repeated records within a file count once for
containment; packing keeps them. Empty input, empty output.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import materialise


def visible(path: str | Column) -> Column:
    """No part of the path starts with `_` or `.`; false for a null path."""
    parts = F.split(F.col(path) if isinstance(path, str) else path, "/")
    return F.coalesce(~F.exists(parts, lambda p: p.rlike("^[_.]")), F.lit(False))


def record_digests(rows: DataFrame, file: str, columns: list[str]) -> DataFrame:
    """(file, h1, h2) of every record."""
    kinds = dict(rows.dtypes)
    same = [F.col(c) + F.lit(0.0) if kinds[c] in ("double", "float") else F.col(c) for c in columns]  # -0.0 is 0.0
    gone = [F.col(c).isNull() for c in columns]  # a null and an absent column must differ from what stands beside
    return rows.select(
        F.col(file).alias("file"), F.xxhash64(*same, *gone).alias("h1"), F.xxhash64(F.lit("second"), *gone, *reversed(same)).alias("h2")
    )


def record_index(rows: DataFrame, files: DataFrame, file: str, path: str, columns: list[str]) -> DataFrame:
    """(file, h1, h2): the distinct records of every visible file."""
    live = files.where(visible(path)).select(F.col(file).alias("file"))
    digests = record_digests(rows.where(F.col(file).isNotNull()), file, columns)
    return digests.join(live, "file", "left_semi").distinct()


def contained(index: DataFrame) -> DataFrame:
    """(file, within): files all of whose records are in one single file with a smaller id; `within` is the first.
    index is read several times: it should be written or checkpointed."""
    firsts = index.groupBy("h1", "h2").agg(F.min("file").alias("first"), F.count(F.lit(1)).alias("files"))
    # whoever has a record first is contained in nothing: this settles nearly every file
    maybe = index.select("file").distinct().join(firsts.select(F.col("first").alias("file")).distinct(), "file", "left_anti")
    maybe = materialise(maybe)
    theirs = index.join(maybe, "file", "left_semi")
    # one representative for all files with the same records
    shape = [F.count(F.lit(1)).alias("n"), *[F.bit_xor(h).alias(f"x{h}") for h in ("h1", "h2")], *[F.sum(F.shiftright(h, 16)).alias(f"s{h}") for h in ("h1", "h2")]]
    shapes = index.groupBy("file").agg(*shape)
    alike = ["n", "xh1", "xh2", "sh1", "sh2"]
    reps = materialise(shapes.groupBy(*alike).agg(F.min("file").alias("rep")))
    mine = shapes.join(maybe, "file", "left_semi").join(reps, alike)
    copies = mine.where("file <> rep").select("file", F.col("rep").alias("within"))
    single = mine.where("file = rep").select("file", "n")
    # the rarest record of a representative names the files it can be within
    theirs = theirs.join(single, "file")
    shared = index.join(theirs.select("h1", "h2").distinct(), ["h1", "h2"], "left_semi")
    shared = shared.join(reps.select(F.col("rep").alias("file")), "file", "left_semi")
    freq = shared.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("files"))
    probe = theirs.join(freq, ["h1", "h2"]).groupBy("file", "n").agg(F.min(F.struct("files", "h1", "h2")).alias("p"))
    holders = shared.select(F.col("file").alias("within"), F.col("h1").alias("p1"), F.col("h2").alias("p2"))
    pairs = probe.join(holders, (F.col("p.h1") == F.col("p1")) & (F.col("p.h2") == F.col("p2")) & (F.col("within") < F.col("file"))).select("file", "n", "within")
    held = (
        pairs.join(theirs.select("file", "h1", "h2"), "file")
        .join(shared.withColumnRenamed("file", "within"), ["within", "h1", "h2"], "left_semi")
        .groupBy("file", "within", "n").agg(F.count(F.lit(1)).alias("m")).where("m = n")
    )
    return held.groupBy("file").agg(F.min("within").alias("within")).unionByName(copies)


def plan(rows: DataFrame, files: DataFrame, file: str, path: str, size: str, columns: list[str], small: int = 16_384) -> DataFrame:
    """(file, path, size, action, within): `drop`, `merge` (smaller than `small`) or `keep` for every live file."""
    index = materialise(record_index(rows, files, file, path, columns))
    gone = contained(index)
    live = files.select(F.col(file).alias("file"), F.col(path).alias("path"), F.col(size).alias("size"))
    live = live.join(index.select("file").distinct(), "file", "left_semi")
    action = F.when(F.col("within").isNotNull(), "drop").when(F.col("size") < small, "merge").otherwise("keep")
    return live.join(gone, "file", "left").select("file", "path", "size", action.alias("action"), "within")


def row_bytes(rows: DataFrame, file: str, order: str) -> DataFrame:
    """(file, content): the rows of every file as lines of JSON, in order, all columns; numbers and times read back as
    they were. For tables whose files aren't at hand; real files come from spark.read.format("binaryFile")."""
    kinds = dict(rows.dtypes)
    cols = [F.unix_micros(c).alias(c) if kinds[c] == "timestamp" else F.col(f"`{c}`") for c in rows.columns]
    line = F.struct(F.col(order).alias("o"), F.to_json(F.struct(*cols)).alias("t"))
    lines = F.transform(F.array_sort(F.collect_list("l")), lambda x: x["t"])
    return rows.select(F.col(file).alias("file"), line.alias("l")).groupBy("file").agg(
        F.encode(F.array_join(lines, "\n"), "UTF-8").alias("content")
    )


def offsets(members: DataFrame, group: str, block_bytes: int = 128 << 20, run: int = 4096) -> DataFrame:
    """The index of members (file, path, content, group): file, path, block, offset, length, checksum (CRC-32). Members
    of different groups never share a block. Offsets have two levels: running sums over at most `run` ids of a group at
    a time, and over the sums of these, so blocks fill up to `block_bytes` though no group is ordered as a whole. A
    member is in the block in which it begins."""
    sized = members.select("file", "path", F.octet_length("content").alias("length"), F.crc32("content").alias("checksum"), F.col(group).cast("string").alias("g"))
    sized = sized.withColumn("run", F.floor(F.col("file") / run)).withColumn("g", F.coalesce(F.concat(F.lit("/"), "g"), F.lit("null")))
    earlier = lambda *by: W.partitionBy(*by).rowsBetween(W.unboundedPreceding, -1)
    sums = sized.groupBy("g", F.col("run").alias("_run")).agg(F.sum("length").alias("bytes")).withColumnRenamed("g", "_g")
    sums = sums.select("_g", "_run", F.coalesce(F.sum("bytes").over(earlier("_g").orderBy("_run")), F.lit(0)).alias("base"))
    sized = sized.join(sums, (F.col("g") == F.col("_g")) & F.col("run").eqNullSafe(F.col("_run")))
    within = F.coalesce(F.sum("length").over(earlier("g", "run").orderBy("file")), F.lit(0))
    sized = sized.withColumn("before", F.col("base") + within)
    sized = sized.withColumn("block", F.concat_ws("/", "g", F.floor(F.col("before") / block_bytes).cast("string")))
    start = F.min("before").over(W.partitionBy("block"))
    return sized.select("file", "path", "block", (F.col("before") - start).alias("offset"), "length", "checksum")


def _opened(folder: str):
    """(file system, folder inside it) on an executor."""
    import pyarrow.fs as fs

    return fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("/") else "file://" + folder.removeprefix("file:"))


def block_name(block: str) -> str:
    return hashlib.md5(block.encode()).hexdigest() + ".block"


def store(members: DataFrame, index: DataFrame, folder: str) -> DataFrame:
    """Writes the blocks as files into a folder that all executors share; (block, members, bytes) of each. A task streams
    its blocks one after the other and holds one member at a time; a file gets its name when it is whole, so a task that
    runs again replaces it by the same bytes."""
    at = index.select(F.col("file").alias("_file"), "block", "offset")
    placed = members.select("file", "content").join(at, F.col("file").eqNullSafe(F.col("_file"))).select("block", "offset", F.octet_length("content").alias("n"), "content")
    placed = placed.repartition("block").sortWithinPartitions("block", "offset", "n")  # empty members before what shares their offset

    def run(batches):
        system, base = _opened(folder)
        system.create_dir(base, recursive=True)
        name, out, done = None, None, []

        def close():
            if out is not None:
                out.close()
                system.move(f"{base}/{tmp}", f"{base}/{block_name(name)}")

        for batch in batches:
            for block, offset, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3)):
                if block != name:
                    close()
                    name, tmp = block, f"_{uuid.uuid4().hex}"
                    out = system.open_output_stream(f"{base}/{tmp}")
                    done.append([block, 0, 0])
                if offset != done[-1][2]:
                    raise ValueError(f"block {block}: a member at {offset}, the file is at {done[-1][2]}")
                data = content.as_buffer()
                out.write(data)
                done[-1][1], done[-1][2] = done[-1][1] + 1, done[-1][2] + data.size
        close()
        if done:
            b, n, size = zip(*done)
            yield pa.RecordBatch.from_arrays([pa.array(b), pa.array(n, pa.int64()), pa.array(size, pa.int64())], names=["block", "members", "bytes"])

    return materialise(placed.mapInArrow(run, "block string, members bigint, bytes bigint"))


def lookup(wanted: DataFrame, folder: str) -> DataFrame:
    """(file, path, content, intact) of rows of the index: each member read by its range. A block's members are read by
    one task in order, big blocks in pieces of about 16 MB."""
    spread = wanted.withColumn("_piece", F.floor(F.col("offset") / (16 << 20)))
    rows = spread.repartition("block", "_piece").sortWithinPartitions("block", "offset").select("file", "path", "block", "offset", "length", "checksum")
    kind = dict(wanted.dtypes)["file"]

    def run(batches):
        system, base = _opened(folder)
        name, source = None, None
        for batch in batches:
            got = []
            for block, offset, length in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4))):
                if block != name:
                    if source is not None:
                        source.close()
                    name, source = block, system.open_input_file(f"{base}/{block_name(block)}")
                got.append(source.read_at(length, offset))
            intact = [zlib.crc32(g) == c for g, c in zip(got, batch.column(5).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(got, pa.binary()), pa.array(intact)], names=["file", "path", "content", "intact"])
        if source is not None:
            source.close()

    return rows.mapInArrow(run, f"file {kind}, path string, content binary, intact boolean")
