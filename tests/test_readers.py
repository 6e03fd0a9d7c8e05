"""Readers of many files: headers in different orders, quotes, bad lines, a portal's export."""

import pytest

from skytable.sources import tables


def written(folder, files: dict[str, str]) -> str:
    for name, text in files.items():
        p = folder / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    return str(folder)


def test_headers_of_each_file(spark, tmp_path) -> None:
    root = written(
        tmp_path,
        {
            "a/one.csv": "name, x ,y\nn1,1,2\n\nn2,3\n",
            "b/two.csv": '\n"y",extra,name,x\n4,"q, ""r""",n3,5\n6,,n4,7,8\n"7",e,"n,5",8\n',
            "c/three.csv": "x,name\n9,n6\n",
            "d/empty.csv": "",
            "d/only.csv": "name,x,y\n",
            "d/a_arcs.csv": "name,x,y\nbad,0,0\n",
            "d/other.txt": "name,x,y\nbad,0,0\n",
        },
    )
    got = {tuple(r) for r in tables.combine_reports(spark, root, ["name", "x", "y"]).collect()}
    assert got == {("n1", "1", "2"), ("n2", "3", None), ("n3", "5", "4"), ("n,5", "8", "7")}
    left = {(r["file_path"].rsplit("/", 1)[1], r["line"], r["reason"]) for r in tables.rejected_lines(spark, root, ["name", "x", "y"]).collect()}
    assert left == {("two.csv", "6,,n4,7,8", "too many fields"), ("three.csv", "9,n6", "no column y")}


def test_variations_leave_long_lines_out(spark, tmp_path) -> None:
    root = written(
        tmp_path,
        {
            "o1/2-OUT/galaxy.csv": "name,fit_state,x\na, OK,1\nb,OK,2,3\nc,bad,4\nd,OK\n",
            "o2/2-OUT/galaxy.csv": "x,fit_state,name\n5,OK,e\n",
            "o3/1-IN/galaxy.csv": "x,fit_state,name\n6,OK,f\n",
        },
    )
    got = {tuple(r) for r in tables.read_variations(spark, root, ["name", "x", "fit_state"]).collect()}
    assert got == {("a", "1", "OK", "o1"), ("d", None, "OK", "o1"), ("e", "5", "OK", "o2")}


def test_portal_export(spark, tmp_path) -> None:
    path = written(tmp_path, {"p.csv": '# a\n# b\n\n#\n\nid,"note, more",dataURI\n1,"x, y",mast:a_i2d.fits\n2,,mast:b_cat.ecsv\n3,z\n'}) + "/p.csv"
    assert [r[0] for r in tables.portal_uris(spark, path).collect()] == ["mast:a_i2d.fits"]
    assert [r[0] for r in tables.portal_uris(spark, path, mosaics_only=False).collect()] == ["mast:a_i2d.fits", "mast:b_cat.ecsv"]
    with pytest.raises(ValueError, match="no column"):
        tables.portal_uris(spark, path, column="uri")
