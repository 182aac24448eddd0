import hashlib
import hmac
import os
import subprocess

import pytest
from pyspark.sql import functions as F

from codelode.functions import text as tx
from codelode.operators import chunks as ch
from codelode.operators import ivf, tables
from codelode.operators import vectors as vx
from codelode.sources import files as sf
from codelode.sources import git as sg
from codelode.sources import store
from codelode.streaming import incremental as inc


def test_upsert_and_diff(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    new = spark.createDataFrame([("b", 3), ("c", 4)], "k string, v int")
    assert {(r.k, r.v, r.outcome) for r in tables.upsert(old, new, ["k"]).collect()} == {("a", 1, "kept"), ("b", 3, "updated"), ("c", 4, "created")}
    assert {(r.k, r.change) for r in tables.snapshot_diff(old, new, ["k"], "v").collect()} == {("a", "deleted"), ("b", "modified"), ("c", "added")}
    assert {(r.k, r.v) for r in tables.bulk_update(old, new, ["k"]).collect()} == {("a", 1), ("b", 3)}


def test_walk_reads_a_tree(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "a" / "x.py").write_text("print(1)\n")
    (tmp_path / "a" / "y.txt").write_text("no")
    (tmp_path / "node_modules" / "z.py").write_text("no")
    rows = sf.walk(spark, str(tmp_path)).collect()
    assert [r.path for r in rows] == ["a/x.py"]
    assert rows[0].content_hash == hashlib.sha256(b"print(1)\n").hexdigest()
    assert rows[0].git_hash == hashlib.sha1(b"blob 9\0print(1)\n").hexdigest() and rows[0].language == "python"


def test_commits_of_a_repository(spark, tmp_path):
    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=n", "-c", "user.email=e@x", *a], check=True, capture_output=True)
    run("init", "-q")
    for i in range(2):
        (tmp_path / "f.py").write_text(f"x = {i}\n")
        run("add", "-A")
        run("commit", "-qm", f"step {i}")
    got = sg.commits(spark, str(tmp_path))
    assert [r.message for r in got.collect()] == ["step 1", "step 0"]
    assert sf.last_commit_per_path(got).collect()[0].path == "f.py"


def test_replace_a_table_it_reads(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(3).write.parquet(path)
    assert store.replace(spark.read.parquet(path).filter("id > 0"), path).count() == 2


def test_merge_stream_is_idempotent(spark, tmp_path):
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    schema = "k string, id long, ts long"
    spark.createDataFrame([("a", 1, 1), ("b", 2, 1), ("a", 1, 1)], schema).write.parquet(src)
    go = lambda: inc.merge_stream(spark.readStream.schema(schema).parquet(src), out, ["k"], "ts").awaitTermination()
    go()
    assert {(r.k, r.ts) for r in inc.current(spark, out).collect()} == {("a", 1), ("b", 1)}
    spark.createDataFrame([("a", 1, 2), ("c", 3, 1), ("b", 2, 0)], schema).write.mode("append").parquet(src)
    go()
    go()
    assert {(r.k, r.ts) for r in inc.current(spark, out).collect()} == {("a", 2), ("b", 1), ("c", 1)}


def test_streamed_sessions(spark, sf_dir):
    got = inc.run_to_end(inc.sessions(inc.event_stream(spark, sf_dir)), "append")
    assert got.count() > 0


def test_line_chunks_cover_every_line(spark):
    text = "\n".join(f"Line {i}" for i in range(1, 201))
    rows = ch.by_lines(spark.createDataFrame([(1, text)], "file_id long, content string")).orderBy("chunk").collect()
    assert (rows[0].start_line, rows[0].end_line, rows[0].has_overlap) == (1, 100, False)
    assert rows[1].start_line == 81 and rows[1].has_overlap
    assert {n for r in rows for n in range(r.start_line, r.end_line + 1)} == set(range(1, 201))


def test_unknown_vector_is_an_error(spark, sf_dir):
    with pytest.raises(ValueError):
        vx.similar_to(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), -1)


def test_ivf_recall(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    found = {(r.id, r.neighbour) for r in ivf.ivf_search(df, "vec_id", lists=8, probes=7).collect()}
    a, b = df.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("a"), F.col("embedding").alias("x")), df.select(F.col("vec_id").alias("b"), F.col("embedding").alias("y"))
    from pyspark.sql.window import Window

    true = a.join(b, F.col("a") != F.col("b")).withColumn("s", vx.cosine("x", "y")).withColumn("r", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("s"), "b"))).filter("r <= 10")
    want = {(r.a, r.b) for r in true.collect()}
    assert len(found & want) / len(want) >= 0.9


def test_scalars(spark):
    one = spark.range(1)
    val = lambda c: one.select(c.alias("v")).first().v
    assert val(tx.compare_versions(F.lit("1.2.3"), F.lit("1.10.0"))) == -1
    assert val(tx.compare_versions(F.lit("x"), F.lit("1.0.0"))) == 0
    assert tuple(val(tx.location(F.lit("a.py:3:4")))) == ("a.py", 3, 4)
    assert tuple(val(tx.location(F.lit("a.py:x")))) == (None, None, None)
    assert val(tx.char_similarity(F.lit("abc"), F.lit("abd"))) == pytest.approx(2 / 3)
    assert val(tx.char_similarity(F.lit(""), F.lit(""))) == 1.0
    assert val(tx.valid_path(F.lit("a/../../../../b"))) is False
    assert tuple(val(F.struct(tx.url_owner(F.lit("git@host:own/rep.git")), tx.url_name(F.lit("git@host:own/rep.git"))))) == ("own", "rep")
    good = "sha256=" + hmac.new(b"s", b"x", hashlib.sha256).hexdigest()
    assert tx.verify_signature(b"x", good, "s") and not tx.verify_signature(b"y", good, "s") and tx.verify_signature(b"y", None, None)


def test_cosine_of_a_zero_vector_is_null(spark):
    df = spark.createDataFrame([([0.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [1.0, 0.0])], "a array<float>, b array<float>")
    assert [r.c for r in df.select(vx.cosine("a", "b").alias("c")).collect()] == [None, 1.0]


def test_shared_dir_is_the_clusters(spark):
    from codelode.session import shared_dir

    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    assert os.path.isdir(shared_dir(spark))


def repository(at, steps=2):
    at.mkdir()
    run = lambda *a: subprocess.run(["git", "-C", str(at), "-c", "user.name=n", "-c", "user.email=e@x", *a], check=True, capture_output=True, env=os.environ | {"GIT_COMMITTER_DATE": when, "GIT_AUTHOR_DATE": when})
    when = "2024-01-01T00:00:00Z"
    run("init", "-q", "-b", "main")
    for i in range(steps):
        when = f"2024-01-0{i + 1}T00:00:00Z"
        (at / f"f{i}.py").write_text(f"def f{i}():\n    return {i}\n")
        run("add", "-A")
        run("commit", "-qm", f"step {i}")
    return run


def test_clone_fetch_and_since(spark, tmp_path):
    from datetime import datetime

    run = repository(tmp_path / "origin")
    url, clone = f"file://{tmp_path}/origin/.git", str(tmp_path / "clones" / "1")
    assert sg.checkout(url, clone) == clone and os.path.exists(f"{clone}/f1.py")
    (tmp_path / "origin" / "g.py").write_text("x = 1\n")
    run("add", "-A")
    run("commit", "-qm", "more")
    run("branch", "other")
    assert os.path.exists(f"{sg.checkout(url, clone)}/g.py") and sg.checkout(url, clone, "other") == clone
    assert sg.git(clone, "rev-parse", "--abbrev-ref", "HEAD").strip() == "other"
    # a folder that is no repository is cloned anew
    (tmp_path / "clones" / "2").mkdir()
    (tmp_path / "clones" / "2" / "junk").write_text("x")
    assert not os.path.exists(f"{sg.checkout(url, str(tmp_path / 'clones' / '2'))}/junk")
    own = f"file://{tmp_path}/origin"
    assert sg.checkout(own, "unused") == f"{tmp_path}/origin"
    c = sg.commits(spark, f"{tmp_path}/origin", "no-such-branch", since=datetime(2024, 1, 2))
    assert [(r.message, r.additions) for r in c.filter("message like 'step%'").collect()] == [("step 1", 2)]
    assert sg.changed_since(sg.commits(spark, f"{tmp_path}/origin"), None).first()[0] == 3
    assert sg.with_token("https://h/x", "t") == "https://t@h/x" and sg.with_token("file:///x", "t") == "file:///x"


def test_a_repository_that_fails_does_not_stop_the_others(spark, tmp_path):
    repository(tmp_path / "a")
    files, report = sg.scan_all(spark, [(1, f"file://{tmp_path}/a"), (2, f"file://{tmp_path}/missing"), (3, f"file://{tmp_path}/missing.git")], str(tmp_path / "clones"))
    assert {(r.repository_id, r.status) for r in report.collect()} == {(1, "success"), (2, "failed"), (3, "failed")} and report.filter("error is not null").count() == 2
    assert {(r.path, r.last_commit_at.day) for r in files.collect()} == {("f0.py", 1), ("f1.py", 2)}


def test_one_file_is_synced_and_parsed(spark, tmp_path):
    repository(tmp_path / "a")
    stored = spark.createDataFrame([(1, "f0.py", "HEAD", "old", None, 1, "python"), (1, "f9.py", "HEAD", "h", None, 1, "python")], "repository_id long, path string, branch string, content_hash string, git_hash string, size int, language string")
    after, entities, errors = sg.sync_file(stored, str(tmp_path / "a"), 1, "f0.py")
    assert {(r.path, r.outcome) for r in after.collect()} == {("f0.py", "updated"), ("f9.py", "kept")}
    assert {(r.kind, r.name) for r in entities.collect()} == {("module", None), ("function", "f0")} and errors.first().errors == []


def test_merge_keeps_the_table_when_the_pointer_is_lost(spark, tmp_path):
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    schema = "k string, id long, ts long"
    put = lambda rows: spark.createDataFrame(rows, schema).write.mode("append").parquet(src)
    go = lambda: inc.merge_stream(spark.readStream.schema(schema).parquet(src), out, ["k"], "ts", parts=4).awaitTermination()
    assert inc.current(spark, out) is None
    put([(f"k{i}", i, 1) for i in range(20)])
    go()
    before = inc.pointer(spark, out)
    put([("k3", 3, 2)])
    go()
    after = inc.pointer(spark, out)
    assert sum(before["folders"][p] != after["folders"][p] for p in before["folders"]) == 1  # only the touched part moved
    assert inc.current(spark, out).count() == 20 and inc.current(spark, out).filter("k = 'k3'").first().ts == 2
    assert len(inc.vacuum(spark, out)) <= 1 and inc.current(spark, out).count() == 20
    os.remove(f"{out}/pointer.json")
    put([("k4", 4, 3)])
    with pytest.raises(Exception, match="no pointer"):
        go()
    with pytest.raises(OSError):
        inc.current(spark, out)


def test_a_failed_replacement_leaves_the_old_table(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    spark.range(3).write.parquet(path)
    real, calls = store.move, []

    def move(s, a, b):
        calls.append(a)
        if len(calls) == 2:
            raise OSError("no")
        real(s, a, b)

    monkeypatch.setattr(store, "move", move)
    with pytest.raises(OSError):
        store.replace(spark.range(9), path)
    assert spark.read.parquet(path).count() == 3
