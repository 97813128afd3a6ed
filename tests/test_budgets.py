
import inspect

import numpy as np
import pyarrow.parquet as pq
import pytest

from palletry.operators import ml, search as S
from palletry.plans.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def one(tmp_path_factory):
    """A folder with the nodes of one instance, and their ids and places."""
    folder = tmp_path_factory.mktemp("one")
    t = pq.read_table(f"{FOLDER}/embeddings.parquet").sort_by("vec_id").slice(0, 50)
    pq.write_table(t, folder / "embeddings.parquet")
    return str(folder), np.round([e[:2] for e in t.column("embedding").to_pylist()], 6)


def test_defaults_are_those_surveyed():
    guided = inspect.signature(S.guided).parameters
    assert (guided["moves"].default, guided["rounds"].default) == (30, 1200)
    assert (ml.FOREST, ml.BOOSTED) == ((200, 20, 2), (400, 6, 0.1)) and inspect.signature(ml.stacked).parameters["k"].default == 5


def test_tours_use_the_whole_budget(spark, one):
    folder, xy = one
    d = S.distances(xy)
    assert QUERIES["tsp_guided"](spark, folder).first().length == pytest.approx(S.length_of(d, S.guided(d, d, 1200, 30)), abs=1e-5)


def test_improve_finds_no_move_left_and_keeps_all_nodes():
    d = S.distances(np.random.default_rng(5).random((40, 2)))
    tour = S.improve(d, S.nearest_neighbour(d))
    assert sorted(tour.tolist()) == list(range(40)) and S.improve(d, tour).tolist() == tour.tolist()
    for i in range(40):
        for j in range(i + 2, 40):
            other = np.r_[tour[: i + 1], tour[i + 1 : j + 1][::-1], tour[j + 1 :]]
            assert S.length_of(d, other) >= S.length_of(d, tour) - 1e-9
