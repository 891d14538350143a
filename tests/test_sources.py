"""Files of symbols, and the store of versions, where files are absent or broken and saves die or meet."""

import datetime as dt

import pandas as pd
import pytest
from panelmill.sources import files, store
from panelmill.sources.versions import MOST_VERSIONS, ConflictError, Versions
from pyspark.sql import functions as F

DAY = dt.datetime(2024, 1, 1)


def at(d):
    return DAY + dt.timedelta(days=d)


@pytest.fixture
def folder(tmp_path):
    """Files of a to d: c has another column, d no symbol column; x is no Parquet; y has a text where others have numbers."""
    base = tmp_path / "base"
    base.mkdir()
    for s in "abcd":
        frame = pd.DataFrame({"datetime": [at(d) for d in range(4)], "symbol": s, "close": [float(d) for d in range(4)]})
        frame = frame.assign(volume=7.0) if s == "c" else frame.drop(columns="symbol") if s == "d" else frame
        frame.to_parquet(base / f"{s}.parquet", coerce_timestamps="us")
    (base / "x.parquet").write_bytes(b"no parquet at all")
    pd.DataFrame({"datetime": [at(0)], "symbol": "y", "close": ["text"]}).to_parquet(base / "y.parquet", coerce_timestamps="us")
    return str(base)


def test_only_the_wanted_files_are_opened(spark, folder):
    df, out = files.read_symbols(spark, folder, ["close", "volume"], symbols=["a", "c"], begin=at(1), end=at(2))
    assert out == {} and {(r.symbol, r.close, r.volume) for r in df.collect()} == {("a", 1.0, None), ("a", 2.0, None), ("c", 1.0, 7.0), ("c", 2.0, 7.0)}
    assert {f.rsplit("/", 1)[-1] for f in df.inputFiles()} == {"a.parquet", "c.parquet"}


def test_absent_and_broken_files_are_named(spark, folder):
    with pytest.raises(files.ReadError) as e:
        files.read_symbols(spark, folder, ["close"], symbols=["a", "b", "x", "y", "zz"])
    assert folder in str(e.value) and all(f"{s}: " in str(e.value) for s in ("x", "y", "zz")) and "a: " not in str(e.value).replace(folder, "")
    df, out = files.read_symbols(spark, folder, ["close"], symbols=["a", "b", "x", "y", "zz"], lenient=True)
    assert set(out) == {"x", "y", "zz"} and df.count() == 8
    for wrong in (lambda: files.read_symbols(spark, folder, ["nothing"], symbols=["a"]), lambda: files.read_symbols(spark, folder, ["close"], symbols=["zz"], lenient=True), lambda: files.listing(spark, folder + "2")):
        with pytest.raises(files.ReadError):
            wrong()


def test_a_file_without_symbols_has_its_name(spark, folder):
    df, _ = files.read_symbols(spark, folder, ["close"], symbols=["d"])
    assert {r.symbol for r in df.collect()} == {"d"}


def test_load_names_what_is_wrong(spark, folder):
    main = folder.rsplit("/", 1)[0]
    got = store.load(spark, store.Catalog(main, {"base": ["close"]}), at(0), at(1), symbols=["a", "b"])
    assert got.count() == 4
    with pytest.raises(files.ReadError, match="zz: there is no such file"):
        store.load(spark, store.Catalog(main, {"base": ["close"]}), at(0), at(1), symbols=["a", "zz"])
    with pytest.raises(files.ReadError, match="no columns"):
        store.load(spark, store.Catalog(main, {"base": []}), at(0))


SHAPE = "datetime timestamp_ntz, symbol string, f double"


def rows_of(kept):
    return sorted((r.symbol, (r.datetime - DAY).days, r.f) for r in kept.read().collect())


def test_saves_append_and_update(spark, tmp_path):
    kept = Versions(spark, str(tmp_path / "store"))
    with pytest.raises(FileNotFoundError):
        kept.read()
    assert kept.save(spark.createDataFrame([(at(0), "a", 1.0), (at(1), "a", 2.0), (at(0), "b", 5.0)], SHAPE), ["f"]) == 1
    kept.save(spark.createDataFrame([(at(1), "a", 9.0), (at(2), "a", 3.0), (at(0), "c", 4.0)], SHAPE), ["f"], append=True)
    assert rows_of(kept) == [("a", 0, 1.0), ("a", 1, 2.0), ("a", 2, 3.0), ("b", 0, 5.0), ("c", 0, 4.0)]
    kept.save(spark.createDataFrame([(at(0), "a", 8.0, 1.5), (at(7), "a", 1.0, 1.0), (at(0), "b", None, 2.5)], SHAPE + ", g double"), ["f", "g"])
    got = {(r.symbol, (r.datetime - DAY).days): (r.f, r.g) for r in kept.read().collect()}
    assert got == {("a", 0): (8.0, 1.5), ("a", 1): (2.0, None), ("a", 2): (3.0, None), ("b", 0): (5.0, 2.5), ("c", 0): (4.0, None)}
    assert {r.symbol for r in kept.read(["b", "c"]).collect()} == {"b", "c"}


def test_a_save_that_dies_changes_nothing(spark, tmp_path, monkeypatch):
    kept = Versions(spark, str(tmp_path / "store"))
    first = spark.createDataFrame([(at(0), "a", 1.0), (at(0), "b", 2.0)], SHAPE)
    kept.save(first, ["f"])
    before, later = rows_of(kept), spark.createDataFrame([(at(0), "a", 7.0)], SHAPE)
    with monkeypatch.context() as m:
        m.setattr(Versions, "_publish", lambda *_: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            kept.save(later, ["f"])
    with monkeypatch.context() as m:  # between the rows and their symbols
        m.setattr(type(later), "distinct", lambda self: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            kept.save(later, ["f"])
    assert rows_of(kept) == before
    kept.save(later, ["f"])
    assert rows_of(kept) == [("a", 0, 7.0), ("b", 0, 2.0)]


def test_of_two_saves_at_once_one_is_told(spark, tmp_path, monkeypatch):
    kept, other = (Versions(spark, str(tmp_path / "store")) for _ in range(2))
    kept.save(spark.createDataFrame([(at(0), "a", 1.0)], SHAPE), ["f"])
    seen = other.manifest()
    kept.save(spark.createDataFrame([(at(0), "a", 2.0)], SHAPE), ["f"])
    monkeypatch.setattr(other, "manifest", lambda: seen)
    with pytest.raises(ConflictError):
        other.save(spark.createDataFrame([(at(0), "a", 3.0)], SHAPE), ["f"])
    assert rows_of(kept) == [("a", 0, 2.0)]


def test_many_versions_become_one(spark, tmp_path):
    kept = Versions(spark, str(tmp_path / "store"))
    for k in range(MOST_VERSIONS + 2):
        kept.save(spark.createDataFrame([(at(k), f"s{k % 3}", float(k))], SHAPE), ["f"], append=True)
    number, versions = kept.manifest()
    assert number == MOST_VERSIONS + 2 and len(versions) == 2 and len(rows_of(kept)) == MOST_VERSIONS + 2


def test_places_over_many_ranges(spark):
    from panelmill.functions.order import numbered

    df = spark.range(0, 5000).select((F.col("id") * 7919 % 5003).alias("v")).repartition(9)
    assert [(r.v, r.place) for r in numbered(df, "v", "place").orderBy("v").collect()] == list(zip(sorted(k * 7919 % 5003 for k in range(5000)), range(5000)))
    assert numbered(df.where("false"), "v", "place").count() == 0


def test_closed_bars_round_times_as_their_sql(spark, tmp_path):
    import duckdb
    from panelmill import catalog

    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    times = ("05:59:59.400000", "05:59:59.500000", "05:59:59.700000", "06:00:00.500000", "11:59:58.500000", "00:00:00.000000")
    values = ", ".join(f"(TIMESTAMP '2024-01-09 {t}', 1::BIGINT, {i}.25::DOUBLE)" for i, t in enumerate(times))
    con.execute(f"COPY (SELECT * FROM (VALUES {values}) v(ts, user_id, value)) TO '{tmp_path}/events.parquet'")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    got = catalog.QUERIES["t01_closed_bars"](spark, str(tmp_path)).select("datetime", "symbol", "close", "n").collect()
    want = con.sql(catalog.ORACLES["t01_closed_bars"]).fetchall()
    assert sorted(map(tuple, got)) == sorted((d, s, float(c), n) for d, s, c, n in want) and len(want) == 2


def test_rows_of_a_study_are_written_once(spark, sf):
    from panelmill import queries

    assert all("panelmill-" in f for f in queries.study(spark, sf).rows.inputFiles())
