import pytest
from compare import same

from pixelloom.plans import registry

SQL = registry.oracle_sql()
QUERIES = registry.queries()


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, sf_dir, name):
    same(spark, sf_dir, QUERIES[name], SQL[name])


#: Slow learner queries run in the driver's check; here those without SQL that run in a second or two.
QUICK = ["changed_windows", "thin_changes", "hard_ring", "separated_extremes", "roberts_in_place", "gaussian_targets", "canny_edges", "thin_edges", "resize_bilinear", "wavelet_cost",
         "orientation_descriptors", "splice_samples", "kernel_spectra", "pca_energy", "saab_fit_transform", "residual_pca", "cwsaab_tree", "pixelhop", "pixelhop_context", "pixelhop_offsets", "point_label_fit"]


@pytest.mark.parametrize("name", QUICK)
def test_runs_and_has_rows(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_entry_works_without_the_text_operators(monkeypatch):
    import builtins
    import importlib
    import sys

    real = builtins.__import__

    def guard(name, g=None, loc=None, fromlist=(), level=0):
        if name.startswith(("pixelloom.llm", "corpus_pipeline")):
            raise ImportError(name)
        return real(name, g, loc, fromlist, level)

    for m in [m for m in sys.modules if m.startswith(("pixelloom.llm", "corpus_pipeline", "__spark_entry__"))]:
        monkeypatch.delitem(sys.modules, m)
    monkeypatch.setattr(builtins, "__import__", guard)
    entry = importlib.import_module("__spark_entry__")
    assert set(entry.queries()) == set(QUERIES) and set(entry.oracle_sql()) == set(SQL)
    monkeypatch.undo()
    sys.modules.pop("__spark_entry__", None)
