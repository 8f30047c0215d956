"""Domains by embeddings against brute force; book metadata from files."""

import json
import random

import pytest

from textloom.operators import domains as D
from textloom.sources import files


def cosine(a, b):
    dot = sum(x * y for x, y in zip(a, b))
    return dot / (sum(x * x for x in a) * sum(x * x for x in b)) ** 0.5


@pytest.fixture(scope="module")
def points():
    rng = random.Random(3)
    middles = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(5)]
    return [(i, [x + rng.gauss(0, 0.35) for x in middles[i % 5]]) for i in range(60)] + [(60, [0.0] * 6), (61, None), (None, [1.0] * 6)]


@pytest.mark.parametrize("least", [0.7, 0.85, 0.97])
def test_near_pairs_are_exact(spark, points, least):
    rows = spark.createDataFrame(points, "id long, vector array<double>")
    found = [(r.x, r.y) for r in D.near_pairs(rows, least).collect()]
    real = points[:60]
    want = {(i, j) for i, a in real for j, b in real if i < j and cosine(a, b) >= least}
    assert len(found) == len(set(found)) and set(found) == want and want


def test_density_clusters(spark, points):
    rows = spark.createDataFrame(points, "id long, vector array<double>")
    real = points[:60]
    near = {i: {j for j, b in real if cosine(a, b) >= 0.9} for i, a in real}
    cores = {i for i in near if len(near[i]) >= 3}
    name = {i: i for i in cores}
    for _ in cores:
        name = {i: min(name[j] for j in near[i] & cores) for i in cores}
    want = {(i, name[i], True) for i in cores} | {(i, min(name[j] for j in near[i] & cores), False) for i in near if i not in cores and near[i] & cores}
    assert {tuple(r) for r in D.density_clusters(rows, 0.9).select("id", "cluster", "core").collect()} == want
    assert len({c for _, c, _ in want}) > 1


def test_no_rows(spark):
    rows = spark.createDataFrame([], "id long, vector array<double>")
    assert D.density_clusters(rows).count() == 0 and D.mergers(rows).count() == 0


def test_books(spark, tmp_path):
    for folder, text in (("a", json.dumps({"title": "T", "author": "A", "pages": 3})), ("b", "{broken")):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "metadata.json").write_text(text)
    assert [(r.folder, r.title, r.pages) for r in files.books(spark, str(tmp_path)).collect()] == [("a", "T", 3)]
