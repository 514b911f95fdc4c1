import numpy as np
import pytest

from gridloom.functions import containers as ct
from gridloom.operators import images
from gridloom.operators.matrix import Matrix
from gridloom.sources import delimited as dl
from gridloom.sources import filesystem as fs


def test_delimited_round_trip(spark, tmp_path):
    m = Matrix.from_rows(spark, [[1.5, 2.25, -3], [4, 5, 6.125]])
    for d in (",", "\t", ";"):
        dl.dlmwrite(m, f"{tmp_path}/x", d)
        assert dl.readmatrix(spark, f"{tmp_path}/x").to_numpy().tolist() == [[1.5, 2.25, -3], [4, 5, 6.125]]


def test_ragged_and_text_cells(spark, tmp_path):
    p = tmp_path / "r.csv"
    p.write_text("1, 2,3\n\nx,5\n7\n")
    got = dl.csvread(spark, str(p)).to_numpy()
    assert np.isnan(got[1, 0]) and got[1].tolist()[1:] == [5, 0] and got[2].tolist() == [7, 0, 0]
    assert dl.csvread(spark, str(p), 1, 1).to_numpy().tolist() == [[5], [0]]
    p.write_text("1 2  3\n4 5 6\n")
    assert dl.readmatrix(spark, str(p)).to_numpy().tolist() == [[1, 2, 3], [4, 5, 6]]


def test_textscan_fscanf_fread(spark, tmp_path):
    p = tmp_path / "t.txt"
    p.write_text("1 2.5 abc\n2 x def\n")
    got = [tuple(r)[1:] for r in dl.textscan(spark, str(p), "%d %f %s").orderBy("line").collect()]
    assert got == [(1, 2.5, "abc"), (2, None, "def")]
    assert [r["v"] for r in dl.fscanf(spark, str(p)).orderBy("k").collect()] == [1, 2.5, 2]
    b = tmp_path / "b.bin"
    assert dl.fwrite(str(b), [1.0, 2.0, 3.5]) == 3
    assert [r["v"] for r in dl.fread(spark, str(b), 2).orderBy("k").collect()] == [1, 2]


def test_save_and_load(spark, tmp_path):
    dl.save(f"{tmp_path}/s", a=Matrix.from_rows(spark, [[1, 2], [3, 4.123456789]]), x=42.0, t="text")
    got = dl.load(spark, f"{tmp_path}/s")
    assert got["a"].to_numpy().tolist() == [[1, 2], [3, 4.123456789]] and got["x"] == 42 and got["t"] == "text"


def test_files(tmp_path):
    d = f"{tmp_path}/d"
    assert fs.mkdir(d) == 1 and fs.mkdir(d) == 0 and fs.isfolder(d) == 1
    open(f"{d}/a.txt", "w").close()
    assert fs.copyfile(f"{d}/a.txt", f"{d}/b.txt") == 1 and fs.movefile(f"{d}/b.txt", f"{d}/c.txt") == 1 and fs.rmdir(d) == 0
    assert [x["name"] for x in fs.dir_(d)] == [".", "..", "a.txt", "c.txt"]
    assert fs.deletefile(f"{d}/zz") == 0 and fs.fileparts("data/results/output.csv") == {"path": "data/results", "name": "output", "ext": ".csv", "filename": "output.csv"}
    with pytest.raises(OSError):
        fs.fopen(f"{d}/none")
    assert fs.c_format("%5.2f|%d|%s%%", 3.14159, 7.9, "q") == " 3.14|7|q%"


@pytest.mark.parametrize("kind", ["bmp", "ppm"])
def test_images(spark, tmp_path, kind):
    im = images.test_pattern(spark, 13, 7)
    a = im.to_numpy()
    im.save(f"{tmp_path}/x.{kind}")
    assert (images.load_image(spark, f"{tmp_path}/x.{kind}").to_numpy() == a).all()
    assert (im.rotate90().to_numpy() == np.rot90(a, -1)).all() and (im.rotate270().to_numpy() == np.rot90(a)).all()
    assert (im.flip_horizontal().to_numpy() == a[:, ::-1]).all() and (im.crop(2, 1, 5, 4).to_numpy() == a[1:5, 2:7]).all()
    assert im.resize(26, 14).to_numpy()[0, 2].tolist() == a[0, 1].tolist()
    assert images.Image.from_matrix(im.grayscale().to_matrix()).to_numpy().shape == (7, 13, 1)
    assert len(im.ascii().split("\n")) == 7


def test_tables(spark):
    t = spark.createDataFrame([(3, "c"), (1, "a"), (2, "b")], "k int, s string")
    assert sorted(map(tuple, ct.add_row(t, 9, "z").collect()))[-1] == (9, "z")
    assert ct.get_row(t, 2, "k").first()["s"] == "b" and ct.remove_row(t, 1, "k").count() == 2
    with pytest.raises(ValueError):
        ct.add_row(t, 1)
