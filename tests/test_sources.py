import json

import numpy as np
import pytest

from fitloom.plans.workflow import run_batch, run_workflow
from fitloom.sources import readers


def write(path, text):
    path.write_text(text)
    return str(path)


def test_text_formats(spark, tmp_path):
    a = readers.load(spark, write(tmp_path / "a.txt", "# c\n1 2 0.1\n\n3\t4 nan # tail\n"), {"x": 0, "y": 1, "sigma": 2})
    assert [tuple(r)[:3] for r in a.orderBy("ord").collect()] == [(1.0, 2.0, 0.1), (3.0, 4.0, None)]
    b = readers.ascii_table(spark, write(tmp_path / "b.dat", "h\n1;2\n3;4\nend;1\n"), {"x": 0, "y": 1}, ";", skip_header=1, skip_footer=1)
    assert [(r.x, r.y) for r in b.orderBy("ord").collect()] == [(1, 2), (3, 4)]
    c = readers.load(spark, write(tmp_path / "c.csv", "# c\nname,x,y\na,1,2\nb,3,NA\n"), {"x": "x", "y": 2})
    assert [(r.x, r.y) for r in c.orderBy("ord").collect()] == [(1, 2), (3, None)]
    with pytest.raises(ValueError):
        readers.detect("a.bin")


def test_archives_and_pasted_text(spark, tmp_path):
    np.savez(tmp_path / "a.npz", u=np.arange(3.0), v=np.arange(3.0) * 2)
    rows = readers.load(spark, str(tmp_path / "a.npz"), {"x": "u", "y": "v"}).orderBy("ord").collect()
    assert [(r.x, r.y) for r in rows] == [(0, 0), (1, 2), (2, 4)]
    p = readers.pasted(spark, "x\ty\n1\t2\n3\t\n").collect()
    assert [(r.x, r.y) for r in p] == [(1, 2), (3, None)]
    assert readers.sniff_delimiter("1,2\n") == "," and readers.sniff_delimiter("1 2") is None


def test_workflow(spark, tmp_path):
    x = np.linspace(0, 4, 50)
    lines = "\n".join(f"{a},{2.5 * np.exp(-1.3 * a) + 0.1},0.1" for a in x)
    path = write(tmp_path / "d.csv", "x,y,sigma\n" + lines + "\n")
    job = f"""
metadata: {{dataset_id: one}}
data: {{input_file: {path}, format: csv, columns: {{x: x, y: y, sigma: sigma}}}}
model: {{type: builtin, name: exponential_decay}}
fitting: {{p0: [1, 1, 0]}}
export: {{results_file: {tmp_path}/out, format: json}}
"""
    f = run_workflow(spark, job)
    np.testing.assert_allclose(f.popt, [2.5, 1.3, 0.1], atol=1e-6)
    out = json.loads(spark.read.text(f"{tmp_path}/out").first()[0])
    assert out["metadata"] == {"dataset_id": "one"} and out["convergence"]["success"]
    got = run_batch(spark, [job, job.replace("one", "two")], [1, 1, 0]).collect()
    assert {r.dataset_id for r in got} == {"one", "two"} and all(r.success for r in got)
    with pytest.raises(ValueError):
        run_workflow(spark, job.replace("p0:", "unknown:"))


def test_titles_headers_and_footers_of_several_files(spark, tmp_path):
    text = tmp_path / "t"
    text.mkdir()
    for f, n in (("b.txt", 2000), ("a.txt", 3)):  # the larger file is read first
        body = "".join(f"{i} {2 * i}\n" for i in range(n))
        (text / f).write_text(f"# note\nx y\n\n{body}sum {n}\n")
    got = readers.ascii_table(spark, str(text), {"x": 0, "y": 1}, skip_header=1, skip_footer=1).orderBy("ord").collect()
    assert [r.x for r in got] == [0.0, 1.0, 2.0, *map(float, range(2000))] and all(r.y == 2 * r.x for r in got)
    sheet = tmp_path / "c"
    sheet.mkdir()
    for f, n in (("b.csv", 4), ("a.csv", 2)):
        rows = "".join(f'{i},"{i}.5",NA\n' for i in range(n))
        (sheet / f).write_text(f"title of {f}\nsecond, line\nx,\"y, named\",z\n# note\n{rows}")
    got = readers.csv_table(spark, str(sheet), {"x": "x", "y": "y, named", "z": 2}, skip_header=2).orderBy("ord").collect()
    assert [(r.x, r.y, r.z) for r in got] == [(float(i), i + 0.5, None) for i in (0, 1, 0, 1, 2, 3)]
    got = readers.csv_table(spark, str(sheet), {"y": 1}, header=False, skip_header=3).orderBy("ord").collect()
    assert [r.y for r in got] == [0.5, 1.5, 0.5, 1.5, 2.5, 3.5]
