"""The command line."""

import numpy as np
import pytest

from tallyfield import cli
from tallyfield.operators import theory
from tallyfield.sources.catalogs import read_catalog


@pytest.fixture
def files(tmp_path):
    rng = np.random.RandomState(4)
    (tmp_path / "bins").write_text("0.5 2\n2 4\n")
    for name, n in (("a", 60), ("b", 80)):
        (tmp_path / f"{name}.txt").write_text("\n".join(" ".join(f"{v:.6f}" for v in [*p, 2.0]) for p in rng.rand(n, 3) * 20))
    return tmp_path


def test_counts(spark, files, capsys):
    args = [str(files / "a.txt"), str(files / "b.txt"), "--bins", str(files / "bins"), "--boxsize", "20"]
    assert cli.main(["DD", *args, "--weights", "--log-upper"], spark) == 0
    rows = [line.split("\t") for line in capsys.readouterr().out.splitlines()]
    expected = theory.DD(read_catalog(spark, str(files / "a.txt")), [0.5, 2, 4], read_catalog(spark, str(files / "b.txt")), boxsize=20.0).collect()
    assert [int(r[3]) for r in rows] == [r.npairs for r in expected] and {r[4] for r in rows} <= {"4.0", "0.0"}
    assert float(rows[0][1]) == pytest.approx(np.log10(2))
    cli.main(["wprp", *args, "--pimax", "3"], spark)
    assert len(capsys.readouterr().out.splitlines()) == 2
    cli.main(["vpf", args[0], "--boxsize", "20", "--rmax", "4", "--radii", "2", "--spheres", "50"], spark)
    assert len(capsys.readouterr().out.splitlines()) == 2


def test_logbins(capsys):
    cli.main(["logbins", "0.1", "10", "2"])
    assert capsys.readouterr().out == "0.1 1\n1 10\n"
