"""Sources, sinks and the labelling stream (round trips and stream = batch)."""

import os

import pytest
from pyspark.sql import functions as F

from issuelens import fixed
from issuelens.operators.labelling import label_issues
from issuelens.sources import io
from issuelens.streaming import label_stream as S


def _issues_csv(tmp_path, spark):
    rows = [("A-1", "Move the module", 'first line\nsecond "quoted" line; with semicolon'),
            ("A-2", None, "update dependency versions"),
            (None, "FooBar refactor", None)]
    d = tmp_path / "in"
    spark.createDataFrame(rows, io.ISSUE_SCHEMA).coalesce(1).write.option("sep", ";").option("header", True) \
        .option("quote", '"').option("escape", '"').csv(str(d / "tmp"))
    src = next((d / "tmp").glob("part-*.csv"))
    out = d / "files"
    out.mkdir()
    target = out / "APACHE_DEMO.csv"
    target.write_bytes(src.read_bytes())
    return str(out), rows


def test_read_issues_round_trip(spark, tmp_path):
    path, rows = _issues_csv(tmp_path, spark)
    df = io.read_issues(spark, path)
    got = sorted((r["Key"] or "", r["Summary"] or "", r["Description"] or "", r["project"]) for r in df.collect())
    assert got == sorted((k or "", s or "", d or "", "APACHE_DEMO") for k, s, d in rows)


def test_require_columns(spark):
    with pytest.raises(ValueError):
        io.require_columns(spark.createDataFrame([("x",)], "other string"), "corpus")
    df = io.require_columns(spark.createDataFrame([("a", None)], "Summary string, Description string"), "labelled")
    assert df.collect()[0]["Summary_Description"] == "a. "
    with pytest.raises(ValueError):
        io.require_columns(spark.createDataFrame([("a",)], "Summary string"), "labelled")


def test_write_labelled_partitioned(spark, tmp_path):
    path, _ = _issues_csv(tmp_path, spark)
    lab = label_issues(io.read_issues(spark, path), fixed.KEYWORDS["seed_expansion"], keep=["project"])
    io.write_labelled(lab, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 3 and back.select("project").distinct().collect()[0][0] == "APACHE_DEMO"


def test_run_record(spark):
    rr = io.run_record(spark, {"epochs": 5, "model": "lr"}, {"f1": 0.5})
    r = rr.collect()[0]
    assert r["params"]["model"] == "lr" and r["metrics"]["f1"] == 0.5


def test_model_save_load_same_predictions(spark, tmp_path):
    from issuelens.operators import active as A
    rows = [(i, f"move code {i}" if i % 2 else f"weather nice {i}", i % 2) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, label int")
    m = A.train_classifier(df)
    A.save_model(m, str(tmp_path / "m"))
    m2 = A.load_model(str(tmp_path / "m"))
    a = A.predict(m, df, ["doc_id"]).orderBy("doc_id").collect()
    b = A.predict(m2, df, ["doc_id"]).orderBy("doc_id").collect()
    assert a == b


def test_stream_equals_batch(spark, tmp_path):
    path, _ = _issues_csv(tmp_path, spark)
    stream = S.label_stream(S.issue_stream(spark, path))
    q = S.start(stream, str(tmp_path / "sink"), str(tmp_path / "ckpt"), available_now=True)
    q.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "sink"))
    batch = label_issues(io.read_issues(spark, path), fixed.KEYWORDS["seed_expansion"], keep=["project"])
    cols = ["Key", "Summary_Description_Preprocessed", "closest_keyword", "similarity_score", "label"]
    norm = lambda d: sorted(tuple(r) for r in d.select(*cols).fillna("").collect())
    assert norm(got) == norm(batch)


def _write(path, *lines):
    path.write_text("\n".join(lines) + "\n")
    return str(path)


def test_issue_columns_by_name(spark, tmp_path):
    """Reordered, missing and extra columns; project names keep their hyphens."""
    a = _write(tmp_path / "foo-a.csv", "Summary;Key;Description", "move;A-1;code")
    b = _write(tmp_path / "foo-b.csv", "Extra;description;Summary", "x;second;first")
    got = {(r.project, r.Key, r.Summary, r.Description) for r in io.read_issues(spark, [a, b]).collect()}
    assert got == {("foo-a", "A-1", "move", "code"), ("foo-b", None, "first", "second")}
    only = io.read_issues(spark, b)
    assert "Key" not in only.columns
    assert label_issues(only, ["move"]).collect()[0].Key.startswith("unknown-")
    with pytest.raises(ValueError):
        io.read_issues(spark, _write(tmp_path / "c.csv", "Key;Summary", "1;x"))


def test_read_corpus_ids(spark, tmp_path):
    path = _write(tmp_path / "c.csv", "id,text", "1,same", "2,same", '3,"two\nlines"')
    rows = io.read_corpus(spark, path).collect()
    assert len({r.doc_id for r in rows}) == 3
    assert sorted(r.text for r in rows) == ["same", "same", "two\nlines"]
    with pytest.raises(ValueError):
        io.read_corpus(spark, _write(tmp_path / "d.csv", "a,b", "1,2"))


def test_read_labelled(spark, tmp_path):
    path = _write(tmp_path / "l.csv", "label,Description,Summary", "1,d,s", "0,,t")
    got = sorted((r.label, r.Summary_Description) for r in io.read_labelled(spark, path).collect())
    assert got == [("0", "t. "), ("1", "s. d")]


def test_curves_round_trip_and_union(spark, tmp_path):
    from issuelens.operators import metrics
    path = _write(tmp_path / "x.csv", ",training_size,accuracy,precision,recall,fscore,model",
                  '0,100,0.5,0.4,0.3,0.2,"A(k=1, m=2)"', "1,200,0.6,0.5,0.4,0.3,B")
    curves = io.read_curves(spark, path)
    io.write_curves(curves, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out")).select(curves.columns)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, curves.collect()))
    got = metrics.union_curves({"a": curves, "b": curves})
    assert sorted(r.model for r in got.collect()) == ["a", "a", "b", "b"]


def test_land_parquet_and_ledger(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id long, part string")
    io.land_parquet(df, str(tmp_path / "p"), ["part"])
    assert sorted(p.name for p in (tmp_path / "p").glob("part=*")) == ["part=a", "part=b"]
    io.write_ledger(df, str(tmp_path / "l"))
    assert spark.read.parquet(str(tmp_path / "l")).count() == 2


def test_parquet_stream_has_its_project(spark, tmp_path):
    rows = spark.createDataFrame([("K-1", "move code", None)], io.ISSUE_SCHEMA)
    rows.coalesce(1).write.parquet(str(tmp_path / "w"))
    (tmp_path / "in").mkdir()
    next((tmp_path / "w").glob("part-*.parquet")).rename(tmp_path / "in" / "some-project.parquet")
    q = S.start(S.label_stream(S.issue_stream(spark, str(tmp_path / "in"), "parquet")), str(tmp_path / "out"),
                str(tmp_path / "ck"), available_now=True)
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).collect()[0].project == "some-project"


def _put(folder, name, text):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text(text)


def test_labelled_files_with_other_column_orders(spark, tmp_path):
    """Columns go by name, also where only some files have them, and a quoted line feed in a header is kept."""
    folder = tmp_path / "lab"
    _put(folder, "a.csv", "Key,Summary,Description,Label\nA-1,move,\"one\ntwo\",1\n")
    _put(folder, "b.csv", "Label,Description,Summary\n0,code,update\n")
    _put(folder, "c.csv", "Label,Summary,Description,\"odd\nname\"\n1,s,d,x\n")
    got = io.read_labelled(spark, str(folder))
    assert sorted((r.Key or "", r.Summary_Description, r.Label, r["odd\nname"]) for r in got.collect()) == [
        ("", "s. d", "1", "x"), ("", "update. code", "0", None), ("A-1", "move. one\ntwo", "1", None)]


def test_header_jobs_do_not_grow_with_the_files(spark, tmp_path):
    tracker = spark.sparkContext.statusTracker()

    def jobs(n):
        folder = tmp_path / f"many{n}"
        for i in range(n):
            _put(folder, f"f{i}.csv", ("Summary;Description\n" if i % 2 else "Description;Summary\n") + f"x{i};y{i}\n")
        spark.sparkContext.setJobGroup(f"g{n}", "headers")
        rows = io.read_issues(spark, str(folder))
        count = len(tracker.getJobIdsForGroup(f"g{n}"))
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        assert rows.count() == n and {r.Summary[0] for r in rows.where("project like '%1' and project not like '%0'").collect()} == {"x"}
        return count
    assert jobs(4) == jobs(24)


def test_corpus_ids_do_not_depend_on_the_splits(spark, tmp_path):
    folder = tmp_path / "corpus"
    for i in range(6):
        _put(folder, f"f{i}.csv", "text\n" + "".join(f"\"row {j % 3}\nof {i}\"\n" for j in range(5 + i)))
    ids = []
    for size in ("128m", "1"):
        before = spark.conf.get("spark.sql.files.maxPartitionBytes")
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        ids.append(sorted((r.text, r.doc_id) for r in io.read_corpus(spark, str(folder)).collect()))
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert ids[0] == ids[1] and len({i for _, i in ids[0]}) == len(ids[0]) == sum(5 + i for i in range(6))


def test_a_stream_of_versions_ends_with_the_newest_labels(spark, tmp_path):
    """Several triggers, keys sent again with another label, a late file with old versions, null keys, and a restart."""
    source, sink, ckpt = tmp_path / "src", str(tmp_path / "sink"), str(tmp_path / "ckpt")
    source.mkdir()

    def send(name, when, *rows):
        (source / f"{name}").mkdir(exist_ok=True)
        path = _write(source / name / "proj.csv", "Key;Summary;Description", *rows)
        os.utime(path, (when, when))

    def run():
        stream = S.label_stream(S.issue_stream(spark, str(source / "*"), max_files_per_trigger=1, columns=["Key", "Summary", "Description"]))
        assert S.start(S.label_changes(stream), sink, ckpt, available_now=True).awaitTermination(180)
        return spark.read.parquet(sink)

    send("one", 1000, "A-1;refactoring;x", "A-2;weather;y", ";refactoring;no key")
    send("two", 3000, "A-1;weather;x", "A-3;refactoring;z", "A-3;restructure;z")
    run()
    send("late", 2000, "A-1;refactoring;late", "A-2;refactoring;newer than one", ";refactoring;no key")
    changes = run()
    files = [(t, f"{source}/{n}/proj.csv") for t, n in ((1000, "one"), (2000, "late"), (3000, "two"))]
    whole = None
    for t, path in files:
        part = io.read_issues(spark, path).withColumn("sent", F.timestamp_seconds(F.lit(t)))
        whole = part if whole is None else whole.unionByName(part)
    every = S.versions(label_issues(whole, fixed.KEYWORDS["seed_expansion"], keep=["project", "sent"]))
    best = every.groupBy("project", "key").agg(F.max_by(F.struct(*every.columns), F.struct("sent", "mark")).alias("v")).select("v.*")
    got, want = (sorted(map(tuple, d.select(every.columns).collect())) for d in (S.newest_labels(changes), best))
    assert got == want and len(want) == 4
    counts = {(r.project, r.label): r.n_issues for r in S.label_counts(changes).collect()}
    assert counts == {(r.project, r.label): r["count"] for r in best.groupBy("project", "label").count().collect()}
    assert changes.where("delta < 0").count() >= 2
