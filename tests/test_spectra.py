import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from helixframe.operators import algebra
from helixframe.operators.spectra import Collection, JointSFS, JointSpectra, Spectra, Spectrum, TwoSFS, TwoSpectra

masses = st.lists(st.floats(0, 1000), min_size=5, max_size=12)


@given(masses)
@settings(max_examples=50, deadline=None)
def test_fold_keeps_mass(x):
    s = Spectrum(x)
    assert np.isclose(s.fold().n_sites, s.n_sites) and s.fold().is_folded()
    assert np.allclose(s.misidentify(0).data, s.data) and np.isclose(s.misidentify(0.3).n_sites, s.n_sites)
    assert np.isclose(s.subsample(3).n_sites, s.n_sites)


def test_spectrum_values():
    s = Spectrum.standard_kingman(10) * 10 + [100, *[0] * 10]
    assert np.isclose(s.Theta, 10) and np.isclose(s.theta, 10 / s.n_sites)
    assert np.isclose(s.scale_theta(0.2).theta, 0.2) and np.isclose(s.scale_theta(0.2).n_sites, s.n_sites)
    assert np.isclose(s.normalize().n_polymorphic, 1) and s.normalize().data[0] == 100
    assert np.allclose(Spectrum.get_neutral(0.01, 1000, 10).data[1:-1], 10 / np.arange(1, 10))
    r = Spectrum([50, 10, 20, 30, 0]).subsample(2, "random", seed=1)
    assert r.n_sites == 110 and Spectrum([5, 4, 3]).resample(0) == Spectrum([5, 4, 3]).resample(0)
    assert (2 - Spectrum([1, 2])).to_list() == [1, 0] and (Spectrum([1, 4]) ** 2).to_list() == [1, 16]
    assert Spectrum.from_json(s.to_json()) == s
    with pytest.raises(ValueError):
        TwoSFS.from_json(s.to_json())


def test_spectra_algebra(tmp_path):
    s = Spectra({"x.a": [1, 2, 3], "x.b": [0, 5, 0], "y.a": [0, 0, 0]})
    assert s["x.*"].types == ["x.a", "x.b"] and s["y.a"].to_list() == [0, 0, 0]
    with pytest.raises(KeyError):
        s["z"]
    assert s.merge_groups(0)["x"].to_list() == [1, 7, 3] and s.merge_groups([1, 0]).types == ["a.x", "b.x", "a.y"]
    with pytest.raises(ValueError):
        s.merge_groups(2)
    assert s.drop_empty().types == ["x.a", "x.b"] and s.drop_zero_entries().types == ["x.a"] and s.drop_sparse(2).types == ["x.b"]
    assert s.all.to_list() == [1, 7, 3] and s.normalize()["x.a"].n_sites == 1 and s.normalize()["y.a"].n_sites == 0
    assert (s + Spectra({"z": [1, 1, 1]})).types == [*s.types, "z"]
    assert (s * pd.Series({"x.a": 2, "x.b": 0, "y.a": 1}))["x.a"].to_list() == [2, 4, 6]
    assert s.combine(Spectra({"x.a": [9, 9, 9]}))["x.a"].to_list() == [9, 9, 9]
    assert s.rename(["a", "b", "c"]).types == ["a", "b", "c"] and s.prefix("p").types[0] == "p.x.a" and not s.replace_dots().has_dots()
    s.to_file(tmp_path / "s.csv")
    assert Spectra.from_file(tmp_path / "s.csv").to_list() == s.to_list()
    (tmp_path / "e.csv").write_text("")
    assert Spectra.from_file(tmp_path / "e.csv").k == 0
    assert Spectra.from_json(s.to_json()).to_list() == s.to_list() and s.n_polymorphic["x.a"] == 2
    with pytest.raises(ValueError):
        Spectra({"a": [1, 2], "b": [1, 2, 3]})


def test_two_site_and_joint():
    rng = np.random.default_rng(0)
    t = TwoSFS(rng.random((7, 7)))
    assert np.isclose(t.fold().data.sum(), t.data.sum()) and t.fold().is_folded() and t.n == 7 and t.w == 4
    c, m = t._covariance()
    assert np.allclose(t.cov().data[1:-1, 1:-1], c[1:-1, 1:-1]) and np.abs(t.corr().data).max() <= 1
    assert np.allclose(TwoSFS(np.outer(range(1, 6), range(1, 6))).fpmi().data, 0)
    with pytest.raises(ValueError):
        t.interior().cov()
    assert np.isnan(t.mask_diagonal().data[0, 0]) and np.isnan(t.mask_upper().data[0, 1])
    j = JointSFS(rng.random((4, 3, 5)), ["a", "b", "c"])
    assert np.allclose(j.marginalize(["c", "a"]).data, j.data.sum(axis=1).T) and np.isclose(j.fold().data.sum(), j.data.sum()) and j.fold().is_folded()
    assert JointSpectra({"t": j}).marginalize(["b"])["t"].n == 2
    with pytest.raises(ValueError):
        Collection().all
    with pytest.raises(ValueError):
        JointSFS(np.zeros((2, 2)), ["a"])
    assert TwoSpectra({"t": t}).all == t


def test_frames_agree_with_arrays(spark):
    rng = np.random.default_rng(1)
    x = {t: rng.random(9) for t in ("a.x", "a.y", "b.x")}
    frame = spark.createDataFrame([(t, i, float(v)) for t, row in x.items() for i, v in enumerate(row)], "type string, bin int, mass double")
    want = Spectra(x)

    def same(df, spectra, n=8):
        assert np.allclose(Spectra.from_long(df.toPandas(), n).to_numpy(), spectra.sort_types().to_numpy())

    same(algebra.fold(frame, 8), want.fold())
    same(algebra.misidentify(frame, 8, 0.2), want._map(lambda s: s.misidentify(0.2)))
    same(algebra.subsample(frame, 8, 3), want._map(lambda s: s.subsample(3)), 3)
    same(algebra.normalize_interior(frame, 8), want._map(Spectrum.normalize))
    same(algebra.normalize_all(frame), want.normalize())
    same(algebra.scale_theta(frame, 8, 0.1), want._map(lambda s: s.scale_theta(0.1)))
    same(algebra.merge_groups(frame, [1]), want.merge_groups(1))
    same(algebra.add(frame, frame), want + want)
    two = spark.createDataFrame([("all", i, j, float(v)) for (i, j), v in np.ndenumerate(np.outer(x["a.x"], x["a.y"]) + np.eye(9))], "type string, i int, j int, mass double")
    t = TwoSFS(np.outer(x["a.x"], x["a.y"]) + np.eye(9))
    for f, m, name in ((algebra.covariance, t.cov(), "cov"), (algebra.correlation, t.corr(), "corr"), (algebra.fpmi, t.fpmi(), "fpmi")):
        rows = f(two, 8).toPandas()
        got = np.zeros((9, 9))
        got[rows["i"], rows["j"]] = rows[name]
        assert np.allclose(got, m.data)
    added = algebra.extrapolate_two(two, frame.where("type = 'a.x'").select("bin", "mass"), 1000, 10, 500, 20, 0.9).toPandas()
    k = 990 / 500 * 20 * 0.9
    border = x["a.x"] * k
    full = t.data.copy()
    full[0] += border
    full[:, 0] += border
    full[0, 0] += 990 * k
    got = np.zeros((9, 9))
    got[added["i"], added["j"]] = added["mass"]
    assert np.allclose(got, full)


def test_fpmi_needs_finite_polymorphic_pairs():
    border = np.zeros((5, 5))
    border[0] = 1
    for bad in (border, np.zeros((5, 5)), np.full((5, 5), np.nan)):
        with pytest.raises(ValueError):
            TwoSFS(bad).fpmi()
    only = np.zeros((5, 5))
    only[1, 2] = only[2, 1] = 3
    assert np.isclose(TwoSFS(only).fpmi().data[1, 2], np.log(2)) and TwoSFS(only).fpmi().data[1, 1] == 0


def test_target_below_what_was_observed(spark):
    """Divergence uses up the target but is not polymorphic: it does not stop the update."""
    sfs = spark.createDataFrame([("a", 0, 5.0), ("a", 1, 30.0), ("a", 2, 80.0), ("b", 0, 1.0), ("b", 1, 2.0), ("b", 2, 0.0)], "type string, bin int, mass double")
    sampled = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", 1.0)], "type string, sampled double")

    def zeros(*args, **options):
        return {r["type"]: r["mass"] for r in algebra.target_sites_1d(sfs, sampled, 2, *args, **options).where("bin = 0").collect()}

    assert zeros(100) == {"a": 0, "b": 48, "c": 25} and zeros(31) == {"a": 5, "b": 1}
    assert zeros(20, keep=False) == {"a": 0, "b": 8, "c": 5} and zeros(20, types="inner", keep=False) == {"a": 0, "b": 8}
    assert zeros(20, types="inner") == {"a": 5, "b": 1}
    with_none = algebra.target_sites_1d(sfs, sampled.where("sampled < 0"), 2, 1000)
    assert sorted(with_none.collect()) == sorted(sfs.collect())


def test_joint_target_below_what_was_observed(spark):
    """The same for joint spectra, whose origin may have no row."""
    rows = [("a", 0, 0, 5.0), ("a", 1, 0, 30.0), ("a", 2, 1, 80.0), ("b", 0, 1, 2.0)]
    joint = spark.createDataFrame(rows, "type string, k_0 int, k_1 int, mass double")
    sampled = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", 1.0)], "type string, sampled double")

    def origins(*args, **options):
        out = algebra.target_sites_joint(joint, sampled, [2, 1], *args, **options)
        assert sorted(map(tuple, out.where("k_0 + k_1 > 0").collect())) == sorted(rows[1:])
        return {r["type"]: r["mass"] for r in out.where("k_0 + k_1 = 0").collect()}

    assert origins(100) == {"a": 0, "b": 48, "c": 25} and origins(31) == {"a": 5}
    assert origins(20, keep=False) == {"a": 0, "b": 8, "c": 5} and origins(20, types="inner", keep=False) == {"a": 0}
    assert origins(800, types="inner") == {"a": 90} and origins(20, types="inner") == {"a": 5}
