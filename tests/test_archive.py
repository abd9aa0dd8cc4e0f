import random

from aerolith.operators import archive

ROWS = "pos_id bigint, file_id bigint, a string, x double, t timestamp"
FILES = "file_id bigint, file_path string, n_bytes bigint"


def planned(spark, rows, files):
    p = archive.plan(spark.createDataFrame(rows, ROWS), spark.createDataFrame(files, FILES), "file_id", "file_path", "n_bytes", ["a", "x", "t"], 100)
    return {r.file: (r.action, r.within) for r in p.collect()}


def test_against_sets(spark):
    rnd = random.Random(4)
    rows, files, n = [], [], 0
    for f in range(1, 60):
        path = rnd.choice(["d/f", "d/f", "d/f", "d/_tmp/f", "d/.f", "_d/f"]) + str(f)
        files.append((f, path, rnd.choice([50, 100, 150])))
        for _ in range(rnd.choice([0, 1, 1, 2, 3])):
            rows.append((n := n + 1, f, rnd.choice(["u", "v", None]), rnd.choice([0.0, -0.0, 1.0, None]), None))
    files.append((99, None, 5))
    rows.append((n + 1, None, "u", 1.0, None))
    have = {}
    for _, f, a, x, t in rows:
        path = next((p for g, p, _ in files if g == f), None)
        if path and not any(p[:1] in ("_", ".") for p in path.split("/")):
            have.setdefault(f, set()).add((a, None if x is None else x + 0.0, t))
    want = {}
    for f, s in have.items():
        within = [g for g in sorted(have) if g < f and s <= have[g]]
        size = next(b for g, _, b in files if g == f)
        want[f] = ("drop", within[0]) if within else ("merge", None) if size < 100 else ("keep", None)
    got = planned(spark, rows, files)
    assert {f: a for f, (a, _) in got.items()} == {f: a for f, (a, _) in want.items()}
    for f, (a, g) in got.items():
        assert a != "drop" or (g < f and have[f] <= have[g])
    assert planned(spark, [], []) == {} and planned(spark, [], files) == {}


def stored(members, tmp, group, *a, **kw):
    index = archive.materialise(archive.offsets(members, group, *a, **kw))
    return index, archive.store(members, index, f"{tmp}/blocks")


def test_packing_is_an_exact_round_trip(spark, tmp_path):
    rnd = random.Random(1)
    members = [(i, f"p/{i}", bytes(rnd.randrange(256) for _ in range(rnd.choice([0, 1, 7, 400]))), rnd.choice(["g", "h", None])) for i in range(120)]
    df = spark.createDataFrame(members, "file bigint, path string, content binary, g string")
    index, blocks = stored(df, tmp_path, "g", block_bytes=1000, run=50)
    assert blocks.count() < 60
    again = archive.store(df, index, f"{tmp_path}/blocks")  # a task that runs again
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, blocks.collect())) and len(list((tmp_path / "blocks").iterdir())) == blocks.count()
    back = {r.file: r for r in archive.lookup(index, f"{tmp_path}/blocks").collect()}
    assert len(back) == 120 and all(bytes(back[i].content) == c and back[i].intact and back[i].path == p for i, p, c, _ in members)
    few = archive.lookup(index.where("file IN (3, 77)"), f"{tmp_path}/blocks").collect()
    assert {r.file: bytes(r.content) for r in few} == {i: members[i][2] for i in (3, 77)}
    assert archive.lookup(stored(df.limit(0), tmp_path / "none", "g")[0], f"{tmp_path}/none/blocks").count() == 0
    broken = next(p for p in (tmp_path / "blocks").iterdir() if p.stat().st_size > 500)
    broken.write_bytes(b"x" + broken.read_bytes()[1:])
    assert archive.lookup(index, f"{tmp_path}/blocks").where("NOT intact").count() == 1


def test_blocks_fill_up_over_windows_of_ids(spark, tmp_path):
    members = [(i, f"p/{i}", bytes([i % 251]) * 10, ["g", "null", None][i % 3]) for i in range(0, 3000)]
    df = spark.createDataFrame(members, "file bigint, path string, content binary, g string")
    index, blocks = stored(df, tmp_path, "g", block_bytes=2500, run=50)  # 10,000 bytes a group, 170 in a window
    sizes = {r.block: r.bytes for r in blocks.collect()}
    assert len(sizes) == 12 and set(sizes.values()) == {2500}
    back = {r.file: r for r in archive.lookup(index, f"{tmp_path}/blocks").collect()}
    assert len(back) == 3000 and all(bytes(back[i].content) == c and back[i].intact for i, _, c, _ in members)


def test_rows_survive_packing(spark, data, tmp_path):
    rows = spark.read.parquet(f"{data}/bronze_positions.parquet")
    content = archive.row_bytes(rows, "file_id", "pos_id").selectExpr("file", "'p' AS path", "content", "'g' AS g")
    back = archive.lookup(stored(content, tmp_path, "g", 5000)[0], f"{tmp_path}/blocks").selectExpr("explode(split(decode(content, 'UTF-8'), '\n')) AS j")
    want = rows.withColumn("timestamp", archive.F.unix_micros("timestamp"))
    got = back.select(archive.F.from_json("j", want.schema).alias("r")).select("r.*")
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
