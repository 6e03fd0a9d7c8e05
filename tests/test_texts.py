"""Names, coordinates and cleaning on literal cases."""

import pytest
from pyspark.sql import functions as F

from skytable.functions import coords, names, report
from skytable.operators import stats
from skytable.plans import reports
from skytable.sources import tables


def values(spark, rows, schema, *cols):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*cols).collect()]


def test_wavebands(spark):
    rows = [
        ("jw01018-c1000_t003_niriss_clear-f150w_i2d.fits", "f150w", "niriss"),
        ("jw01021-o003_t006_nircam_f405n-f444w_i2d.fits", "f405n-f444w", "nircam"),
        ("jw01018-o005_t003_fgs_clear_i2d.fits", "clear", "fgs"),
        ("jw01685013001_02101_00004_nrca1_i2d.fits", "unclassified", None),
        ("jw01021-o004_t006_nircam_f322w2-f323n_i2d.fits", "f322w", "nircam"),
    ]
    got = values(spark, rows, "n string, b string, i string", "b", names.waveband(F.col("n")), "i", names.instrument(F.col("n")))
    assert all(r[0] == r[1] and r[2] == r[3] for r in got)


def test_names(spark):
    one = spark.range(1)
    made = names.object_file_name(F.lit(80.483566), F.lit(-69.482915), F.lit("clear-f070w"), F.lit(1), F.lit("nircam"))
    assert one.select(made).first()[0] == "80.483566_-69.482915_nircam_clear-f070w_v1.fits"
    p = one.select(names.parse_object_file_name(F.lit("80.485303_-69.517493_f150w_v1.fits")).alias("p")).first().p
    assert (p.ra, p.dec, p.waveband, p.version) == (80.485303, -69.517493, "f150w", 1)
    assert one.select(names.parse_object_file_name(F.lit("80.4_x_f150w_v1.fits")).alias("p")).first().p is None
    p = one.select(names.parse_report_name(F.lit("t045_8870+0_5025_r")).alias("p")).first().p
    assert (p.ra, p.dec) == (45.8870, 0.5025)
    assert one.select(names.parse_report_name(F.lit("t045_8870+0_5025_g")).alias("p")).first().p is None
    assert one.select(names.underscore_to_file(F.lit("218_144041_-44_192128_f115w_v1"))).first()[0] == "218.144041_-44.192128_f115w_v1.fits"
    p = one.select(names.parse_legacy_name(F.lit("RA22h14m55s_DEC+45d22m30s_v1.fits")).alias("p")).first().p
    assert (round(p.ra, 6), p.dec, p.version) == (333.729167, 45.375, 1)
    assert one.select(coords.fixed_text(F.lit(38.495), 2), coords.fixed_text(F.lit(-0.5), 0 + 1)).first()[:] == ("38.49", "-0.5")
    texts = one.select(*[names.score_text(F.lit(t)) for t in ("0.50", "1.0", "1E-3", " 7 ")]).first()
    assert tuple(texts) == ("0.5", "1", "0.001", "7")


def test_sexagesimal_minus_zero(spark):
    assert spark.range(1).select(coords.sexagesimal_dec(F.lit("-00:30:00"))).first()[0] == -0.5


def test_shards(spark):
    got = values(spark, [(10000,), (10001,)], "n long", names.shard_number(F.col("n"), 10000))
    assert [r[0] for r in got] == [1, 2]
    with pytest.raises(ValueError):
        names.shard_number(F.col("n"), 0)


def test_pixel_round_trip(spark):
    ra, dec = coords.pixel_to_sky(F.lit(0.0036), F.lit(100.0), F.lit(80.0), F.lit(37.0), F.lit(12.0), F.lit(359.9999), F.lit(60.0))
    x, y, _ = coords.sky_to_pixel(F.lit(0.06 / 3600), F.lit(100.0), F.lit(80.0), F.col("ra"), F.col("dec"), F.lit(359.9999), F.lit(60.0))
    r = spark.range(1).select(ra.alias("ra"), dec.alias("dec")).select(x.alias("x"), y.alias("y")).first()
    assert abs(r.x - 37) < 1e-6 and abs(r.y - 12) < 1e-6


def test_report_columns():
    assert len(report.REPORT_COLUMNS) == len(set(report.REPORT_COLUMNS)) == 154
    assert report.report_schema(True).fieldNames()[:3] == ["index", "P_CW", "P_ACW"]


COLUMNS = ["index", "P_CW", "P_ACW", "name", "fit_state", "warnings", "star_mask_used", "noise_mask_used", "chirality_maj", "badBulgeFitFlag",
           "bulgeAxisRatio", "top2_chirality_agreement", "covarFit", "likOfCtr"]


def row(**changes):
    base = dict(zip(COLUMNS, ["0", "0.5", "0", "g", "OK", "w", "none", "none", "Z-wise", "true", "0.5", "<2 arcs", "[1 2; 3 4]", "0+5.6e-09i"]))
    return tuple({**base, **changes}[c] for c in COLUMNS)


def test_sanitize(spark):
    rows = [row(), row(bulgeAxisRatio=" Inf "), row(fit_state="input rejected"), row(bulgeAxisRatio=""), row(star_mask_used="unavailable", warnings="NaN")]
    raw = spark.createDataFrame(rows, report.text_schema(COLUMNS))
    clean = reports.sanitize_report(raw, "infer")
    got = clean.collect()
    assert len(got) == 1
    g = got[0]
    assert (g.chirality_maj, g.badBulgeFitFlag, g.top2_chirality_agreement, g.covarFit, g.likOfCtr) == ("Zwise", "True", "'<2_arcs'", "[1 2  3 4]", "0")
    assert reports.sanitize_report(clean, "infer").collect() == got
    counts = {r.reason: r.n for r in reports.sanitize_counts(raw).collect()}
    assert counts == {"kept": 1, "bad_value": 2, "input_rejected": 1, "blank_key": 1}


def test_arrays(spark):
    got = values(spark, [("[1 2 3]",), ("4_5",), ("7 x",), (None,)], "s string", report.parse_array(F.col("s")), F.size(report.parse_array(F.col("s"), True)))
    assert got[0] == ([1.0, 2.0, 3.0], 1) and got[1] == ([4.0, 5.0], 1) and got[3] == ([], 0)
    assert got[2][0][0] == 7.0 and got[2][0][1] != got[2][0][1]


def test_readers(spark, tmp_path):
    header = ",".join(COLUMNS)
    line = ",".join(row())
    for name, text in {
        "a/galaxy.csv": f"{header}\n{line}\n", "a/x_arcs.csv": f"{header}\n{line}\n", "b/empty.csv": "", "b/only.csv": header + "\n",
        "v/obj1/2-OUT/galaxy.csv": f"{header}\n{line}\n", "v/obj2/2-OUT/galaxy.csv": f"{header}\n{line.replace('OK', 'bad')}\n",
    }.items():
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    assert tables.combine_reports(spark, str(tmp_path / "a"), COLUMNS).count() == 1
    assert tables.combine_reports(spark, str(tmp_path / "b"), COLUMNS).count() == 0
    got = tables.read_variations(spark, str(tmp_path / "v"), COLUMNS).collect()
    assert [r.object_id for r in got] == ["obj1"]


def test_download_manifest(spark, tmp_path):
    named = tmp_path / "named.csv"
    named.write_text('dataURI,productFilename,calib_level\n"mast:a,1",a.fits,3\nmast:b,b.fits,2\n')
    legacy = tmp_path / "legacy.csv"
    legacy.write_text(",".join({6: "mast:c", 14: "c.fits", 18: "3"}.get(i, "x") for i in range(20)) + "\nshort,row\n")
    assert [tuple(r) for r in tables.read_download_manifest(spark, str(named)).collect()] == [("mast:a,1", "a.fits")]
    assert [tuple(r) for r in tables.read_download_manifest(spark, str(legacy)).collect()] == [("mast:c", "c.fits")]


def test_listing(spark, tmp_path):
    for n in ("a.FITS", "b.fits", "c.txt", "d.png"):
        (tmp_path / n).write_bytes(b"x")
    assert tables.list_images(spark, str(tmp_path)).count() == 2
    every = tables.list_images(spark, str(tmp_path), tables.IMAGE_PATTERN)
    assert {r.kind for r in tables.majority_images(every).collect()} == {"fits"}


def test_eta(spark):
    got = spark.range(1).select(stats.eta_text(F.lit(10), F.lit(20), F.lit(3700.0)), stats.eta_text(F.lit(0), F.lit(5), F.lit(9.0))).first()
    assert tuple(got) == ("1:01:40", "N/A")
    assert tables.csv_name("out/x.parquet") == "out/x.csv" and tables.csv_name("x.CSV") == "x.CSV"
