"""Manifests, lookups, splits, FITS bytes, models and the registry."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from skytable.operators import images, lookup, manifests, models, ranking, sampling
from skytable.sources import fits
from skytable.sources.tables import MANIFEST_COLUMNS


def test_normalize_good_and_bad_rows(spark):
    rows = [
        (1, "jw_good_b_i2d.fits", "mast:b", "3.0", "image"), (2, "jw_good_a_i2d.fits", None, "3.0", "image"), (3, "jw_bad_level_i2d.fits", None, "2", "image"),
        (4, "jw_bad_type_i2d.fits", None, "3", "spectrum"), (5, "jw_bad_suffix_x1d.fits", None, "3", "image"), (6, "jw_good_b_i2d.fits", "mast:other", "3", "image"),
    ]
    raw = spark.createDataFrame(rows, "id int, filename string, uri string, productLevel string, dataproduct_type string")
    got = manifests.normalize_products(raw, "id").orderBy("productFilename").collect()
    assert [(r.productFilename, r.dataURI, r.calib_level, r.obs_collection) for r in got] == [
        ("jw_good_a_i2d.fits", "mast:JWST/product/jw_good_a_i2d.fits", "3", "JWST"), ("jw_good_b_i2d.fits", "mast:b", "3", "JWST"),
    ]


def test_normalize_without_levels(spark):
    rows = [(1, "jw_live_i2d.fits", "NIRCAM", "PUBLIC"), (2, "jw_live_cat.ecsv", "NIRCAM", "PUBLIC"), (3, "jw_live_i2d.jpg", "NIRCAM", "PUBLIC")]
    got = manifests.normalize_products(spark.createDataFrame(rows, "id int, filename string, instrument_name string, access string"), "id").collect()
    assert [(r.productFilename, r.calib_level, r.instrume, r.dataRights) for r in got] == [("jw_live_i2d.fits", "3", "NIRCAM", "PUBLIC")]


def test_merge(spark):
    def part(rows):
        df = spark.createDataFrame(rows, "id int, productFilename string, dataURI string")
        return df.select("id", *[F.col(c) if c in df.columns else F.lit("").alias(c) for c in MANIFEST_COLUMNS])

    got = manifests.merge_manifests([part([(1, "b", "one"), (2, "a", "one")]), part([(1, "b", "two"), (2, "c", "two")])], "id").collect()
    assert [(r.productFilename, r.dataURI) for r in got] == [("a", "one"), ("b", "one"), ("c", "two")]
    with pytest.raises(ValueError, match="dataRights"):
        manifests.merge_manifests([part([(1, "b", "one")]).drop("dataRights")], "id")


def test_product_order(spark):
    rows = [("x_flc.fits", 2), ("x_drz.fits", 3), ("hst_x_drc.fits", 3)]
    df = spark.createDataFrame(rows, "f string, lv int").orderBy(ranking.product_rank(F.col("f"), F.col("lv")))
    assert [r.f for r in df.collect()] == ["hst_x_drc.fits", "x_drz.fits", "x_flc.fits"]


def test_row_without_extension_is_not_reusable(spark):
    df = spark.createDataFrame([("Hubble", "p", None), ("Hubble", "p", "sci"), ("JWST", "p", "SCI")], "scope string, path string, ext_name string")
    got = [r[0] for r in df.select(lookup.reusable_source("Hubble", F.lit(True))).collect()]
    assert got == [False, True, False]


def test_labels_without_folder_and_columns(spark):
    labels = spark.createDataFrame([("1-galaxies", "a.png")], "label_dir string, score_filename string")
    wanted = spark.createDataFrame([("1-galaxies",), ("1-not-galaxies",)], "label_dir string")
    assert [tuple(r) for r in lookup.missing_label_dirs(wanted, labels).collect()] == [("1-not-galaxies", "missing_label_dir")]
    got = manifests.column_differences(spark, ["b", "a"], ["a", "c"]).collect()
    assert [tuple(r) for r in got] == [("b", "missing"), ("c", "extra")]


def test_new_files_stream(spark, tmp_path):
    from skytable.streaming import jobs

    folder = tmp_path / "in"
    folder.mkdir()
    for n in ("a.fits", "b.FITS", "c.txt"):
        (folder / n).write_bytes(b"xyz")
    rows = jobs.run_to_table(jobs.new_files(spark, str(folder)).select("path", "length"))
    assert sorted(r.path[-6:] for r in rows.collect()) == ["a.fits", "b.FITS"]


def test_written_tables_can_be_deleted(spark):
    from skytable import session

    df = session.cut_lineage(spark.range(5))
    assert df.count() == 5
    path = session._written[-1]
    session._written[:] = [path]
    assert session.forget_written(spark) == 1 and session._written == []


@pytest.fixture(scope="module")
def scores(spark):
    r = np.random.default_rng(0)
    p = np.concatenate([r.random(600), np.ones(30), np.full(300, 0.05)])
    return spark.createDataFrame(pd.DataFrame({"name": [f"g{i}" for i in range(len(p))], "P_spiral": p})).cache()


def test_bucket_split(scores):
    split = sampling.bucket_split(scores, "P_spiral", ["name"], 4)
    assert split.count() == scores.count() == split.select("name").distinct().count()
    sizes = {r[0] for r in split.filter("split = 'train'").groupBy(F.least(F.floor(F.col("P_spiral") * 4), F.lit(3))).count().select("count").collect()}
    assert len(sizes) == 1
    again = sampling.bucket_split(scores, "P_spiral", ["name"], 4)
    assert split.join(again, ["name", "split"]).count() == scores.count()


def test_validation_and_assembly(scores):
    held = sampling.validation_names(scores, "P_spiral", ["name"])
    extra = scores.limit(5).withColumn("other", F.lit(1))
    train, val = sampling.assemble_training(scores, held, extra)
    assert train.columns == scores.columns and val.count() == held.count()
    assert train.count() + val.count() == scores.count() + 5
    assert train.join(val, "name", "left_semi").count() <= 5


def test_random_rank_is_a_permutation(scores):
    got = sorted(r[0] for r in ranking.random_rank(scores, [], ["name"], 3, "rank").select("rank").collect())
    assert got == list(range(1, scores.count() + 1))


def test_renumber(spark):
    df = ranking.renumber(spark.range(1000).withColumn("k", F.pmod(F.col("id") * 7919, F.lit(1000))), [F.col("k")], "n")
    assert df.filter("n <> k").count() == 0


def test_components_of_long_chain(spark):
    edges = spark.createDataFrame([(1, i, i + 1) for i in range(60)] + [(1, 100, 101), (2, 5, 6)], "g int, a int, b int")
    got = {(r.g, r.node): r.root for r in images.connected_components(edges, ["g"]).collect()}
    assert all(got[(1, i)] == 0 for i in range(61)) and got[(1, 101)] == 100 and got[(2, 6)] == 5


def fits_bytes(*units):
    out = b""
    for cards, data in units:
        text = "".join(f"{k:<8}= {v:<70}"[:80].ljust(80) for k, v in cards) + "END".ljust(80)
        out += text.ljust(-(-len(text) // 2880) * 2880).encode()
        out += data.ljust(-(-len(data) // 2880) * 2880, b"\0")
    return out


def test_fits(spark, tmp_path):
    image = np.arange(6, dtype=">f4").reshape(2, 3)
    raw = fits_bytes(
        ([("SIMPLE", "T"), ("BITPIX", "8"), ("NAXIS", "0"), ("INSTRUME", "'MIRI    ' / camera")], b""),
        ([("XTENSION", "'IMAGE'"), ("BITPIX", "-32"), ("NAXIS", "2"), ("NAXIS1", "3"), ("NAXIS2", "2"), ("EXTNAME", "'SCI'")], image.tobytes()),
    )
    (tmp_path / "a.fits").write_bytes(raw)
    files = fits.read_bytes(spark, str(tmp_path))
    assert fits.instrument_of(files).first().instrument == "MIRI"
    card = fits.first_header_cards(files).filter("keyword = 'INSTRUME'").first()
    assert (card.value, card.comment) == ("MIRI", "camera")
    p = fits.load_pixels(files).first()
    assert (p.h, p.w, list(p.pixels)) == (2, 3, [0.0, 1.0, 2.0, 3.0, 4.0, 5.0])
    rows = fits.pixel_rows(fits.load_pixels(files), "path").filter("y = 1 and x = 2").collect()
    assert [r.v for r in rows] == [5.0]


def test_forest_spread_and_encoder(spark):
    r = np.random.default_rng(1)
    x = r.random((300, 2))
    df = spark.createDataFrame(pd.DataFrame({"a": x[:, 0], "b": x[:, 1], "y": x[:, 0] * 0.8, "flagged_non_galaxy": [False] * 299 + [True]}))
    model = models.fit_forest(df, ["a", "b"], "y", 5, 2, 4)
    got = models.score_spirality(model, df).toPandas()
    trees = [t.copy().setFeaturesCol("features").setPredictionCol("prediction").transform(model.stages[0].transform(df)).toPandas().prediction for t in model.stages[-1].trees]
    assert np.allclose(got.tree_std[:-1], np.std(np.array(trees), axis=0)[:-1])
    assert got.predicted_P_spiral.iloc[-1] == 0 and got.tree_std.iloc[-1] == 0
    # The plan has the same length for five trees and for forty; unfinite features and no rows at all have results.
    more = models.fit_forest(df, ["a", "b"], "y", 40, 2, 4)
    length = lambda m: len(models.predict_spread(m, df)._jdf.queryExecution().optimizedPlan().toString().splitlines())
    assert length(model) == length(more)
    odd = spark.createDataFrame([(float("nan"), 0.5), (None, None), (float("inf"), -1.0)], "a double, b double")
    assert all(r.tree_std >= 0 and 0 <= r.prediction <= 1 for r in models.predict_spread(more, odd).collect())
    assert models.predict_spread(more, odd.limit(0)).count() == 0
    text = spark.createDataFrame([("b",), ("a",), ("c",)], "t string")
    codes = models.fit_encoder(text, ["t"])
    new = spark.createDataFrame([("c",), ("zz",), (None,)], "t string")
    assert sorted(r.t for r in models.encode(new, codes, ["t"]).collect()) == [0, 0, 2]


def test_registry_is_consistent():
    import __spark_entry__ as entry

    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 100


@pytest.mark.parametrize("name", ["C1_nearest_match", "N1_normalize_products", "N3_sanitize_report_infer", "H20_gini", "S7_retry_ledger", "L9_known_leaves"])
def test_query_against_sql(spark, name):
    import duckdb

    import __spark_entry__ as entry

    folder = "/root/testdata/sf0.001"
    got = entry.queries()[name](spark, folder).toPandas()
    db = duckdb.connect()
    for t in "part supplier orders customer lineitem events embeddings documents labels".split():
        db.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    want = db.sql(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and len(got) == len(want)
    cols = sorted(got.columns)
    text = lambda d: sorted(tuple(str(round(v, 5)) if isinstance(v, float) else str(v) for v in r) for r in d[cols].itertuples(index=False))
    assert text(got) == text(want)
