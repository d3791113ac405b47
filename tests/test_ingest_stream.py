"""End-to-end ingestion (batch and streaming) on delimited files written from the test tables."""

import os
import tempfile

from pyspark.sql import functions as F

from quarry.operators import clean as C
from quarry.plans.views import raw_orders
from quarry.sources import store
from quarry.sources.ingest import ingest
from quarry.streaming import file_ingest
from tests.conftest import SMALL


def _csv_dir(spark, parts=3):
    d = tempfile.mkdtemp(prefix="quarry-csv-")
    src = raw_orders(spark, SMALL).withColumnRenamed("order_date", "Order Date")
    src.repartition(parts).write.option("header", "true").csv(os.path.join(d, "in"))
    files = sorted(os.path.join(d, "in", f) for f in os.listdir(os.path.join(d, "in")) if f.endswith(".csv"))
    return d, files, src.count()


def test_batch_ingest(spark):
    d, files, n = _csv_dir(spark)
    rep = ingest(spark, files, os.path.join(d, "points"), os.path.join(d, "registry"), name="orders").first()
    assert rep["status"] == "success"
    pts = store.read_points(spark, os.path.join(d, "points"))
    empty = raw_orders(spark, SMALL).na.drop("all").count()
    assert pts.count() == empty == rep["total_records"]
    assert rep["dropped_empty_rows"] == n - empty
    assert rep["schema"]["datetime_column"] == "order_date" and len(rep["schema"]["column_profiles"]) == 10
    assert {f["flag"] for f in rep["quality_flags"]} >= {"EMPTY_ROWS_DROPPED"} and rep["generated_at"] is not None
    idx = [r[0] for r in pts.select("row_index").collect()]
    assert len(set(idx)) == len(idx) and max(idx) < n  # original positions, unique
    reg = store.list_datasets(spark.read.parquet(os.path.join(d, "registry"))).first()
    assert reg["status"] == "success" and reg["datetime_column"] == "order_date"
    got = store.time_range(pts, reg["id"], "1995-01-01", "1995-12-31", 10)
    assert got.count() == 10
    store.update_status(spark, os.path.join(d, "registry"), reg["id"], "archived")
    assert store.get_dataset(spark.read.parquet(os.path.join(d, "registry")), reg["id"]).first()["status"] == "archived"
    import pytest

    with pytest.raises(KeyError):
        store.update_status(spark, os.path.join(d, "registry"), "nope", "failed")


def test_streaming_ingest(spark):
    d, files, n = _csv_dir(spark, parts=2)
    raw = raw_orders(spark, SMALL)
    roles = C.plan_roles(raw)
    schema = ", ".join(f"`{c}` string" for c in raw.columns)
    drop = os.path.join(d, "drop")
    raw.write.option("header", "true").csv(drop)
    q = file_ingest.start(spark, drop, schema, roles, os.path.join(d, "points"), os.path.join(d, "ckpt"), "stream")
    q.awaitTermination(300)
    pts = store.read_points(spark, os.path.join(d, "points"))
    assert pts.where(F.col("dataset_id") == "stream").count() == raw.na.drop("all").count()
    # a restart with nothing new processes nothing more (checkpointed file log)
    q2 = file_ingest.start(spark, drop, schema, roles, os.path.join(d, "points"), os.path.join(d, "ckpt"), "stream")
    q2.awaitTermination(300)
    assert store.read_points(spark, os.path.join(d, "points")).count() == raw.na.drop("all").count()


def test_failed_ingest_leaves_no_points(spark, monkeypatch):
    import pytest

    d, files, _ = _csv_dir(spark, parts=1)
    monkeypatch.setattr(C, "transformation_report", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        ingest(spark, files, os.path.join(d, "points"), os.path.join(d, "registry"), name="orders", dataset_id="x")
    assert not [f for _, _, fs in os.walk(os.path.join(d, "points")) for f in fs if f.endswith(".parquet")]
    assert store.list_datasets(spark.read.parquet(os.path.join(d, "registry"))).first()["status"] == "failed"


def test_a_batch_written_twice_counts_once(spark):
    d = tempfile.mkdtemp(prefix="quarry-points-")
    rec = spark.range(5).select(F.col("id").alias("row_index"), F.lit(None).cast("timestamp_ntz").alias("timestamp"),
                                F.lit("{}").alias("payload"), F.lit(True).alias("is_valid"))
    for batch in (0, 1, 1):
        store.write_points(rec, d, "x", batch=batch)
    assert store.read_points(spark, d).count() == 10


def _file(folder, name, data):
    path = os.path.join(folder, name)
    with open(path, "wb") as f:
        f.write(data)
    return path


def test_delimited_text_as_written(spark):
    from quarry.sources.delimited import read_delimited

    d = tempfile.mkdtemp(prefix="quarry-delimited-")
    rows = lambda *files: [r.asDict() for r in read_delimited(spark, list(files)).collect()]
    assert rows(_file(d, "q.csv", b'x,y\n"a ""b"" c",1\n')) == [{"x": 'a "b" c', "y": "1"}]
    assert rows(_file(d, "n.csv", b'x,y\n"two\nlines",1\nz,2\n')) == [{"x": "two\nlines", "y": "1"}, {"x": "z", "y": "2"}]
    got = rows(_file(d, "h1.csv", b"x,y\n1,2\n"), _file(d, "h2.csv", b"y,x\n3,4\n"), _file(d, "h3.csv", b"x,z\n5,N/A\n"))
    assert sorted(got, key=lambda r: r["x"]) == [{"x": "1", "y": "2", "z": None}, {"x": "4", "y": "3", "z": None}, {"x": "5", "y": None, "z": None}]
    latin = "x,y\nK\u00f6ln,1\n".encode("latin-1")
    assert rows(_file(d, "c d.csv", latin), _file(d, "u.csv", "x,y\nZ\u00fcrich,2\n".encode())) == [{"x": "K\u00f6ln", "y": "1"}, {"x": "Z\u00fcrich", "y": "2"}]


def test_column_suggestions_follow_types(spark):
    from quarry.sources.delimited import line_fingerprints, suggest_columns

    df = spark.createDataFrame([], "product_stock string, stock int, category_id int, brand string, output double, day date")
    assert suggest_columns(df) == {"production": "output", "stock": "stock", "defect": None, "category": "product_stock", "date": "day", "sales": "stock"}
    d = tempfile.mkdtemp(prefix="quarry-prints-")
    a, b, c = (_file(d, n, x) for n, x in (("a.csv", b"x\n1\n"), ("b.csv", b"x\n1\n"), ("c.csv", b"x\n2\n")))
    prints = [r["md5"] for r in line_fingerprints(spark, [a, b, c]).orderBy("path").collect()]
    assert prints[0] == prints[1] != prints[2]


def test_stream_reads_files_as_the_batch_does(spark):
    """Swapped headers, doubled quotes, line breaks, tabs, another encoding, odd names, an absent and an extra column, an empty file."""
    d = tempfile.mkdtemp(prefix="quarry-stream-")
    drop = os.path.join(d, "in")
    os.mkdir(drop)
    _file(drop, "a.csv", b"Unit Price,name\n1,alpha\n2,\"b \"\"q\"\" c\"\n")
    _file(drop, "b.csv", b"name,Unit Price\nbeta,3\n\"two\nlines\",4\n")
    _file(drop, "c.tsv", b"name\tunit-price\ngamma, with comma\t5\n")
    _file(drop, "d.txt", "name,extra\nKöln,9\nNA,N/A\n".encode("latin-1"))
    _file(drop, "e f.csv", b"name,unit price\nspaced,6\n")
    _file(drop, "empty.csv", b"")
    _file(drop, "ignored.json", b"{}")
    roles = C.Roles(numeric=["unit_price"], text=["name"])
    points, ckpt = os.path.join(d, "points"), os.path.join(d, "ckpt")
    schema = "`Unit Price` string, name string"
    file_ingest.start(spark, drop, schema, roles, points, ckpt, "s", max_files_per_trigger=3).awaitTermination(300)

    def stored():
        rows = store.read_points(spark, points).select("row_index", store.field_text("name").alias("n"), store.field_text("unit_price").cast("double").alias("p")).collect()
        assert len({r["row_index"] for r in rows}) == len(rows)
        return sorted(((r["n"], r["p"]) for r in rows), key=str)

    want = [("alpha", 1.0), ('b "q" c', 2.0), ("beta", 3.0), ("two\nlines", 4.0), ("gamma, with comma", 5.0), ("Köln", None), ("spaced", 6.0)]
    assert stored() == sorted(want, key=str)
    _file(drop, "late.csv", b"unit price,name\n7,late\n")
    file_ingest.start(spark, drop, schema, roles, points, ckpt, "s").awaitTermination(300)
    assert stored() == sorted([*want, ("late", 7.0)], key=str)


def _published(spark, path):
    return sorted(r["row_index"] for r in store.read_points(spark, path).collect())


def _stage(spark, folder, dataset, first):
    rec = spark.range(first, first + 3).select(F.col("id").alias("row_index"), F.lit(None).cast("timestamp_ntz").alias("timestamp"),
                                               F.lit("{}").alias("payload"), F.lit(True).alias("is_valid"))
    store.write_points(rec, folder, dataset)


def test_publish_replaces_and_survives_a_failed_move(spark, monkeypatch):
    import pytest

    d = tempfile.mkdtemp(prefix="quarry-publish-")
    points, staged = os.path.join(d, "points"), os.path.join(d, "staged")
    _stage(spark, staged, "x", 0)
    store.publish_points(spark, staged, points, "x")
    assert _published(spark, points) == [0, 1, 2]
    _stage(spark, staged, "x", 10)
    move, calls = store._move, []

    def failing(fs, source, target):
        calls.append(str(source))
        if len(calls) == 2:                      # the new data does not get into place
            raise OSError("rename failed")
        move(fs, source, target)

    monkeypatch.setattr(store, "_move", failing)
    with pytest.raises(OSError):
        store.publish_points(spark, staged, points, "x")
    assert _published(spark, points) == [0, 1, 2]
    monkeypatch.setattr(store, "_move", move)
    os.rename(os.path.join(points, "dataset_id=x"), os.path.join(points, "_replaced-x"))    # as after a stop between the two moves
    with pytest.raises(OSError):
        store.publish_points(spark, os.path.join(d, "nowhere"), points, "x")
    assert _published(spark, points) == [0, 1, 2]
    store.publish_points(spark, staged, points, "x")
    assert _published(spark, points) == [10, 11, 12] and not os.path.exists(os.path.join(points, "_replaced-x"))


def test_report_claims_success_only_with_points(spark, monkeypatch):
    import pytest

    from quarry.sources import ingest as I

    d, files, _ = _csv_dir(spark, parts=1)
    points, registry = os.path.join(d, "points"), os.path.join(d, "registry")
    publish = store.publish_points
    monkeypatch.setattr(store, "publish_points", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        ingest(spark, files, points, registry, name="orders", dataset_id="x")
    reports = lambda: spark.read.parquet(f"{registry}_reports")
    assert [r["status"] for r in reports().collect()] == ["staged"] and I.current_reports(reports()).count() == 0
    monkeypatch.setattr(store, "publish_points", publish)
    one = _file(d, "one.csv", b"Order Date,amount\n2024-01-02,5\n2024-01-03,6\n")
    first = ingest(spark, files, points, registry, name="orders", dataset_id="x").collect()
    second = ingest(spark, [one], points, registry, name="orders", dataset_id="x").collect()       # the same id again
    assert len(first) == len(second) == 1 and second[0]["total_records"] == 2 != first[0]["total_records"]
    assert store.read_points(spark, points).count() == 2
    now = I.current_reports(reports()).collect()
    assert [(r["dataset_id"], r["total_records"]) for r in now] == [("x", 2)]


def test_roles_follow_the_values(spark):
    from quarry.sources.delimited import column_kinds, suggest_roles

    rows = [("2024-01-0%d" % (i % 9 + 1), "n/a" if i == 3 else f"${i}.50", f"item {i}", None, str(i), 1.0 if i else None, "x") for i in range(10)]
    df = spark.createDataFrame(rows, "shipped string, amount string, brand string, stock string, output_code string, defect_rate double, day string")
    assert {r["column"]: r["kind"] for r in column_kinds(df).collect()} == {
        "shipped": "date", "amount": "number", "brand": "text", "stock": "empty", "output_code": "number", "defect_rate": "number", "day": "text"}
    assert {r["role"]: r["column"] for r in suggest_roles(df).collect()} == {
        "sales": "amount", "production": "output_code", "defect": "defect_rate", "category": "brand", "date": "shipped"}
    assert suggest_roles(df.limit(0)).collect() == []


def test_transfers_at_any_grain(spark):
    from quarry.operators.inventory import transfer_suggestions

    rows = [("2024-02-01", "north", "p", 10.0, 4.0), ("2024-02-01", "north", "p", 10.0, 4.0), ("2024-02-01", "south", "p", 2.0, 10.0),
            ("2024-02-01", "south", "p", 2.0, 20.0), ("2024-01-01", "south", "p", 1.0, 900.0)]
    df = spark.createDataFrame(rows, "date string, region string, product string, sales double, stock double")
    assert [tuple(r) for r in transfer_suggestions(df).collect()] == [("p", "south", "north", 12.0)]


def test_line_fingerprints_see_the_order_and_no_splits(spark):
    from quarry.sources.delimited import line_fingerprints

    d = tempfile.mkdtemp(prefix="quarry-order-")
    lines = [f"line {i % 97} of {i % 13}" for i in range(4000)]
    swapped = lines.copy()
    swapped[10], swapped[3001] = swapped[3001], swapped[10]
    shifted = lines[1:] + lines[:1]
    files = {n: _file(d, f"{n}.csv", "\n".join(x).encode()) for n, x in
             (("a", lines), ("same", lines), ("swapped", swapped), ("shifted", shifted), ("less", lines[:-1]))}

    def prints():
        return {os.path.basename(r["path"])[:-4]: (r["md5"], r["length"]) for r in line_fingerprints(spark, list(files.values())).collect()}

    whole = prints()
    assert whole["a"] == whole["same"] and len({md5 for md5, _ in whole.values()}) == 4
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")      # many splits a file
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        assert prints() == whole
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
