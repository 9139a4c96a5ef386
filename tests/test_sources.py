"""Sinks, manifests, digests, event logs and the plans end to end."""

import hashlib
import io
import json
import shutil

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import zstandard
from pyspark.sql import functions as F

import fixtures as fx
import workload
from judgelens.functions.hashing import sha_key
from judgelens.operators import provenance
from judgelens.plans import study
from judgelens.plans.prepare import prepare
from judgelens.sources import eventlog, files, streams, tables
from judgelens.sources.staging import shared_folder

SF = "/root/testdata/sf0.001"


def test_metric_json_keeps_nulls_and_refuses_nan(spark, tmp_path):
    rows = spark.createDataFrame([("a", None, 1.0)], "name string, x double, y double")
    tables.write_metrics(rows, str(tmp_path / "ok"))
    text = "".join(p.read_text() for p in (tmp_path / "ok").glob("*.json"))
    assert json.loads(text) == {"name": "a", "x": None, "y": 1.0}
    for bad in ("NaN", "Infinity"):
        with pytest.raises(Exception, match="not finite"):
            tables.write_metrics(rows.withColumn("y", F.lit(bad).cast("double")), str(tmp_path / bad))


def test_split_scan_reads_one_directory(spark, tmp_path):
    path = str(tmp_path / "features")
    tables.write_features(fx.features(spark, SF), path)
    plan = tables.read_split(spark, path, "validation")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(dataset_split" in plan
    found = tables.read_split(spark, path, "validation").select("dataset_split").distinct().collect()
    assert [r[0] for r in found] == ["validation"]


def test_scope_filter_is_pushed_to_the_scan_and_columns_are_pruned(spark, tmp_path):
    from judgelens.operators.joins import scope_pairs

    path = str(tmp_path / "pairs")
    fx.pairs(spark, SF).withColumn("__index_level_0__", F.lit(0)).write.parquet(path)
    pairs = scope_pairs(tables.read_pairs(spark, path), "us").select("query_id")
    spark.conf.set("spark.sql.maxMetadataStringLength", 1000)
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "EqualTo(product_locale,us)" in plan and "EqualTo(large_version,1)" in plan
    assert "ReadSchema: struct<query_id:bigint,product_locale:string,large_version:bigint>" in plan


def test_manifest_finds_every_kind_of_change(spark, tmp_path):
    old, new = tmp_path / "old", tmp_path / "new"
    for name, content in {"a/one": b"1", "a/two": b"2", "three": b"3", ".hidden": b"x"}.items():
        target = old / name
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_bytes(content)
    shutil.copytree(old, new)
    (new / "a/two").write_bytes(b"changed")
    (new / "three").unlink()
    (new / "four").write_bytes(b"4")
    frozen, current = (files.artifact_manifest(spark, str(p)) for p in (old, new))
    assert {r.path: r.sha256 for r in frozen.collect()} == {
        name: hashlib.sha256(text).hexdigest() for name, text in {"a/one": b"1", "a/two": b"2", "three": b"3"}.items()
    }
    changes = {r.path: r.status for r in provenance.manifest_diff(frozen, current).collect()}
    assert changes == {"a/two": "changed", "three": "missing", "four": "added"}
    provenance.verify_freeze(frozen, frozen)
    with pytest.raises(ValueError, match="changed since"):
        provenance.verify_freeze(frozen, current)


def test_file_manifest_checks_header_digest_and_rows(spark, tmp_path):
    spark.range(10).coalesce(1).write.parquet(str(tmp_path / "t"))
    manifest = files.file_manifest(spark, str(tmp_path / "t"))
    (row,) = manifest.collect()
    content = next((tmp_path / "t").glob("*.parquet")).read_bytes()
    assert (row.bytes, row.row_count, row.is_parquet) == (len(content), 10, True)
    assert row.sha256 == hashlib.sha256(content).hexdigest()
    files.assert_manifest(manifest, {row.filename: row.sha256})
    with pytest.raises(ValueError):
        files.assert_manifest(manifest, {row.filename: "0" * 64})
    with pytest.raises(ValueError):
        files.assert_manifest(manifest, {"absent.parquet": row.sha256})


class Gapped:
    """A file whose first four bytes are followed by a hole of 2 GiB; what is written knows its true place."""

    def __init__(self, path):
        self.file, self.closed = open(path, "wb"), False

    def write(self, data):
        done = self.file.write(data)
        if self.file.tell() == 4:
            self.file.seek(1 << 31, io.SEEK_CUR)
        return done

    def tell(self):
        return self.file.tell()

    def flush(self):
        self.file.flush()

    def close(self):
        self.file.close()
        self.closed = True


def test_manifest_query_holds_a_file_above_two_gib_against_a_second_digest(spark, tmp_path):
    table = pa.table({"x": range(1000)})
    pq.write_table(table, tmp_path / "small.parquet")
    sink = Gapped(tmp_path / "large.parquet")
    pq.write_table(table, sink)
    sink.close()
    assert (tmp_path / "large.parquet").stat().st_size > 1 << 31
    found = sorted(tuple(r) for r in workload.file_manifest(spark, str(tmp_path)).collect())
    assert found == [("large.parquet", 1000, True, True), ("small.parquet", 1000, True, True)]


@pytest.mark.parametrize("damage", [{"sha256": F.reverse, "bytes": F.abs}, {"sha256": F.lower, "bytes": lambda n: F.col(n) + 1}])
def test_manifest_query_sees_a_wrong_digest_and_a_wrong_size(spark, tmp_path, monkeypatch, damage):
    for name in ("a b", "c%20d"):
        pq.write_table(pa.table({"x": [name]}), tmp_path / f"{name}.parquet")
    assert [r.digest_agrees for r in workload.file_manifest(spark, str(tmp_path)).collect()] == [True, True]
    sound = files.file_manifest
    monkeypatch.setattr(files, "file_manifest", lambda *a: sound(*a).withColumns({n: f(n) for n, f in damage.items()}))
    assert [r.digest_agrees for r in workload.file_manifest(spark, str(tmp_path)).collect()] == [False, False]


def test_digest_ignores_order_and_sees_every_row(spark):
    rows = [("train", i, f"text {i % 7}") for i in range(200)] + [("test", 1, "text")]
    frame = spark.createDataFrame(rows, "dataset_split string, query_id bigint, query_norm string")
    digest = lambda df: {r.dataset_split: r.digest for r in provenance.query_digest(df).collect()}
    base = digest(frame)
    assert base == digest(frame.union(frame).repartition(5).orderBy(F.desc("query_id")))
    changed = digest(frame.filter("NOT (dataset_split = 'train' AND query_id = 5)"))
    assert changed["train"] != base["train"] and changed["test"] == base["test"]


def event_file(path, task_events, finished=True):
    lines = [
        {"Event": "SparkListenerApplicationStart", "App ID": "app-1", "App Name": "job", "Timestamp": 1000},
        {"Event": "SparkListenerEnvironmentUpdate", "Spark Properties": {"spark.master": "local[4]", "spark.driver.memory": "4g"}},
        {"Event": "SparkListenerJobStart", "Job ID": 0},
        {"Event": "SparkListenerStageCompleted", "Stage Info": {}},
        *task_events,
    ]
    if finished:
        lines.append({"Event": "SparkListenerApplicationEnd", "Timestamp": 3500})
    path.write_text("\n".join(json.dumps(line) for line in lines))


def test_event_logs_are_summed_and_incomplete_ones_refused(spark, tmp_path):
    task = {
        "Event": "SparkListenerTaskEnd",
        "Task Info": {"Executor ID": "driver"},
        "Task Metrics": {
            "Executor Run Time": 7,
            "Shuffle Read Metrics": {"Remote Bytes Read": 1, "Local Bytes Read": 2},
            "Shuffle Write Metrics": {"Shuffle Bytes Written": 5},
        },
    }
    bare = {"Event": "SparkListenerTaskEnd", "Task Info": {"Executor ID": "1"}}
    event_file(tmp_path / "app-1", [task, task, bare])
    summary = eventlog.eventlog_summary(eventlog.read_event_logs(spark, str(tmp_path)))
    row = summary.first()
    assert (row.application_id, row.application_name, row.jobs, row.completed_stages, row.completed_tasks) == ("app-1", "job", 1, 1, 3)
    assert (row.shuffle_read_bytes, row.shuffle_write_bytes, row.executor_run_time_ms_sum) == (6, 10, 14)
    assert (row.master, row.driver_memory, row.application_wall_seconds) == ("local[4]", "4g", 2.5)
    assert row.executor_ids == ["1", "driver"]
    event_file(tmp_path / "app-2", [bare], finished=False)
    with pytest.raises(Exception, match="app-2: the application has no start or end"):
        eventlog.eventlog_summary(eventlog.read_event_logs(spark, str(tmp_path))).collect()


def rolled(folder, lines, cuts, names):
    """Lines cut into files; names that end with .zstd, or .zstd.compact, are packed."""
    folder.mkdir(parents=True, exist_ok=True)
    for name, a, b in zip(names, [0, *cuts], [*cuts, len(lines)]):
        text = ("\n".join(lines[a:b]) + "\n").encode()
        (folder / name).write_bytes(zstandard.compress(text) if ".zstd" in name else text)


def test_rolling_packed_and_compacted_logs_give_the_row_of_the_plain_one(spark, tmp_path):
    task = {"Event": "SparkListenerTaskEnd", "Task Info": {"Executor ID": "3"}, "Task Metrics": {"Executor Run Time": 4}}
    (tmp_path / "plain").mkdir()
    event_file(tmp_path / "plain" / "one", [task] * 20)
    lines = (tmp_path / "plain" / "one").read_text().split("\n")
    summary = lambda path, rolling: [tuple(map(str, r)) for r in eventlog.eventlog_summary(eventlog.read_event_logs(spark, str(path), rolling)).collect()]
    expected = summary(tmp_path / "plain", False)
    folder = tmp_path / "rolling" / "eventlog_v2_app-1"
    rolled(folder, lines, [3, 9, 15], ["events_2_app-1.zstd.compact", "events_3_app-1", "events_4_app-1.zstd", "events_5_app-1.zstd"])
    rolled(folder, lines, [5], ["events_1_app-1.zstd", "events_2_app-1.zstd"])  # older than the compacted file
    (folder / "appstatus_app-1").write_text("")
    assert summary(tmp_path / "rolling", True) == expected
    rolled(tmp_path / "single", lines, [], ["app-1.zstd"])
    assert summary(tmp_path / "single", False) == expected


@pytest.mark.parametrize(
    "names, reason",
    [
        (["events_1_a", "events_3_a"], "rolling files"),
        (["events_2_a"], "rolling files"),
        (["events_4_a.compact", "events_6_a.zstd"], "rolling files"),
        (["events_1_a", "appstatus_a.inprogress"], "still writing"),
        (["events_1_a.lz4"], "codec"),
        (["a.inprogress"], "still writing"),
    ],
)
def test_incomplete_logs_are_refused_by_name(names, reason):
    with pytest.raises(ValueError, match=f"logs/a: .*{reason}"):
        eventlog.current_files("logs/a", names)


def test_files_above_two_gib_are_hashed_in_chunks(spark, tmp_path):
    size = (1 << 31) + 5
    with open(tmp_path / "large.bin", "wb") as handle:
        handle.truncate(size)  # a sparse file
    (tmp_path / "_metadata").write_bytes(b"abc" * 1000)
    found = {r.path: r for r in streams.file_digests(spark, str(tmp_path)).collect()}
    sha, zeros = hashlib.sha256(), bytes(1 << 20)
    for _ in range(size >> 20):
        sha.update(zeros)
    sha.update(bytes(size % (1 << 20)))
    assert (found["large.bin"].bytes, found["large.bin"].sha256) == (size, sha.hexdigest())
    assert found["_metadata"].sha256 == hashlib.sha256(b"abc" * 1000).hexdigest() and bytes(found["_metadata"].head) == b"abca"


@pytest.mark.parametrize("chunk", [1, 3, 4096])
def test_streams_hold_a_chunk_at_most(chunk):
    class Counted(io.BytesIO):
        most = 0

        def read(self, n=-1):
            assert n >= 0
            self.most = max(self.most, n)
            return super().read(n)

    text = "one\ntwo ä\n\nlast"
    stream = Counted(text.encode())
    assert streams.digest_of(stream, chunk) == (len(text.encode()), b"one\n", hashlib.sha256(text.encode()).hexdigest())
    assert stream.most == chunk
    assert list(streams.lines_of(Counted(text.encode()), chunk)) == ["one", "two ä", "", "last"]
    assert list(streams.lines_of(Counted(b""), chunk)) == []


def test_small_files_share_a_task_and_large_ones_do_not():
    files_of = [("a", 3), ("b", 4), ("c", 30), ("d", 1), ("e", 9), ("f", 1)]
    assert streams.by_size(files_of, 10) == [["a", "b"], ["c"], ["d", "e"], ["f"]]


def test_a_changed_file_with_an_underscore_is_found(spark, tmp_path):
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "_common_metadata").write_bytes(b"1")
    (tmp_path / "m" / ".hidden").write_bytes(b"1")
    frozen = spark.createDataFrame(files.artifact_manifest(spark, str(tmp_path)).collect(), "path string, bytes long, sha256 string")
    assert frozen.count() == 1
    (tmp_path / "m" / "_common_metadata").write_bytes(b"2")
    with pytest.raises(ValueError, match="_common_metadata"):
        provenance.verify_freeze(frozen, files.artifact_manifest(spark, str(tmp_path)))


def test_shared_folder_comes_from_the_session(spark):
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")


def test_study_end_to_end(spark, tmp_path):
    root = str(tmp_path)
    pairs, products = fx.pairs(spark, SF), fx.products(spark, SF)
    saved = prepare(spark, pairs, products, "us", f"{root}/features", key_hash=sha_key, reports=f"{root}/reports")
    audit = spark.read.json(f"{root}/reports/data_audit").first()
    assert saved.count() == audit.n_pairs - audit.excluded_rows and audit.joined_rows == audit.n_pairs
    assert spark.read.json(f"{root}/reports/query_digests").count() == 3
    assert saved.count() == fx.features(spark, SF).count()
    comparison = {r.model: r for r in study.train(spark, root).collect()}
    assert set(comparison) == {"majority", "logistic_unweighted", "logistic_class_weighted"}
    assert sum(r.selected for r in comparison.values()) == 1 and not comparison["majority"].selected
    best = max(comparison[name].macro_f1 for name in comparison if name != "majority")
    assert [r.macro_f1 for r in comparison.values() if r.selected] == [best]
    for name in ("logistic_unweighted", "logistic_class_weighted"):
        assert spark.read.json(f"{root}/metrics/{name}_validation_review").count() == 2
        assert spark.read.json(f"{root}/metrics/{name}_fit").first().iterations > 0
    results = study.evaluate(spark, root, replicates=10)
    assert results["majority"].first().n_rows == results["classification"].first().n_rows
    assert results["class_tradeoff"].count() == 12 and results["budget_comparison"].count() == 4
    assert results["slice_classes"].count() % 4 == 0 and results["slice_random"].count() > 0
    test_rows = saved.filter("dataset_split = 'test'").count()
    assert results["classification"].first().n_rows == test_rows
    assert sum(r.n for r in results["confusion"].collect()) == test_rows
    assert results["slices"].count() == 9 and results["uncertainty"].count() == 4
    (tmp_path / "features" / "dataset_split=test" / "extra.parquet").write_bytes(b"PAR1")
    with pytest.raises(ValueError, match="changed since"):
        study.evaluate(spark, root, replicates=10)


def test_statements_are_cut_outside_of_quotes_and_comments():
    from judgelens.operators.audits import split_statements

    text = """-- first; not cut
SELECT ';' AS a, "x;y" AS b, 'it''s; fine' AS c; /* none;
here */ SELECT `d;e` FROM t -- end;
;  ;"""
    found = split_statements(text)
    assert [x.split()[0] for x in found] == ["SELECT", "SELECT"]
    assert found[0].count(";") == 3 and found[1] == "SELECT `d;e` FROM t"
    assert split_statements(" -- nothing\n") == []


def test_cases_of_pairs_that_share_an_id(spark, tmp_path):
    """Order 1 with part 1,000,005 and order 2 with part 5 have the same example id; they are two pairs all the same."""
    sf, part = str(tmp_path), "p_partkey long, p_name string, p_brand string, p_type string, p_size int"
    # The anchor of an order is the part whose key is the order's modulo the number of parts.
    names = {0: "red oak", 1: "blue one", 2: "blue two", 3: "blue three", 5: "old oak", 7: "red elm", 1_000_005: "blue fir"}
    spark.createDataFrame([(key, name, "Brand#1", "TIN", 7) for key, name in names.items()], part).write.parquet(f"{sf}/part.parquet")
    spark.createDataFrame([(1,), (2,), (3,)], "o_orderkey long").write.parquet(f"{sf}/orders.parquet")
    lines = [(1, 1_000_005, 1, "A"), (2, 5, 1, "N"), (2, 7, 2, "N"), (3, 7, 1, "R")]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_linenumber int, l_returnflag string").write.parquet(f"{sf}/lineitem.parquet")
    columns = ("example_id", "label", "prediction", "p_e", "title_token_count")
    rows = fx.scored_features(spark, sf).where("label <> prediction").select(*columns).collect()
    found = workload.case_csv_sink(spark, sf).select(*columns).collect()
    assert sorted(found) == sorted(rows) and [r.label for r in sorted(rows) if r.example_id == 2_000_005] == ["C", "E"]
    # The same pair twice is refused as before.
    spark.createDataFrame([(1, "blue one", "Brand#1", "TIN", 7)], part).write.mode("append").parquet(f"{sf}/part.parquet")
    with pytest.raises(ValueError, match="not sound"):
        workload.case_csv_sink(spark, sf)
