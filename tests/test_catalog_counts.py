"""Registered model queries ask for the reference's rounds, repeats and offsets."""
import pytest

from orbweave.operators import learn, trajectory
from orbweave.plans import catalog, catalog_models, catalog_trajectory


class Asked(Exception):
    pass


def asked(*args, **named):
    raise Asked(args, named)


@pytest.mark.parametrize("name, module, function, position, argument, least", [
    ("logistic_select_test", learn, "boosted", 3, "rounds", 300),
    ("permutation_importance", learn, "permutation_importance", 3, "repeats", 10),
    ("offset_sweep", trajectory, "offset_sweep", 4, "offsets", range(5, 26))])
def test_whole_counts(monkeypatch, name, module, function, position, argument, least):
    monkeypatch.setattr(module, function, asked)
    monkeypatch.setattr(learn, "fit", lambda *a: None)
    monkeypatch.setattr(learn, "logistic", lambda *a: None)
    monkeypatch.setattr(catalog_models, "model_rows", lambda s, d: None)

    class Frame:
        def __getattr__(self, _):
            return lambda *a, **k: self
    for f in ("landmarks", "cameras"):
        monkeypatch.setattr(catalog_trajectory, f, lambda *a: Frame())
    for f in ("col", "lit"):
        monkeypatch.setattr(catalog_trajectory.F, f, lambda *a: _Column())
    with pytest.raises(Asked) as e:
        catalog.QUERIES[name](None, None)
    args, named = e.value.args
    value = named[argument] if argument in named else args[position]
    assert set(least) <= set(value) if isinstance(least, range) else value >= least


class _Column:
    def alias(self, _):
        return self

    def __add__(self, _):
        return self
