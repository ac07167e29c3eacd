"""License scans, Merkle manifests and centroid clustering against brute force."""

import hashlib
import math
import random
import re
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from etlspec.llm import clustering, licenses, manifest
from tests.llm.test_operators import LONG, SCHEMA, WORDS

WORD = "[0-9a-z\x80-\U0010ffff]+"


def _words(text):
    return re.findall(WORD, re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))


# ---- license scans


def _scan(text, notices, phrases, threshold):
    w, step, out = _words(text), licenses.step(notices, phrases), set()
    for b in range(0, len(w), step):
        block = set(w[b : b + 2 * step])
        end = min(len(w), b + 2 * step)
        for label, some in notices.items():
            for template in some:
                t = set(_words(template))
                if t and len(t & block) >= threshold * len(t) - 1e-9:
                    out.add((label, template, b, end, len(t & block) / len(t), None))
        for label, some in phrases.items():
            for template in some:
                t = _words(template)
                places = tuple(p for p in range(b, min(len(w), b + step)) if t and w[p : p + len(t)] == t)
                if places:
                    out.add((label, template, b, end, 1.0, places))
    return out


@pytest.fixture(scope="module")
def licensed(spark):
    rng = random.Random(4)
    filler = WORDS + "the of and in under license version public this is a software".split()
    templates = [t for named in (licenses.NOTICES, licenses.PHRASES) for some in named.values() for t in some]
    texts = [None, "", " \n ", "Under the MIT License", "under the mit license under the mit license", LONG, "UNDER THE\nMIT, LICENSE é"]
    for _ in range(60):
        words = rng.choices(filler, k=rng.randrange(0, 150))
        for _ in range(rng.randrange(3)):
            t = _words(rng.choice(templates))
            for _ in range(rng.randrange(3)):
                t.pop(rng.randrange(len(t)))
            at = rng.randrange(len(words) + 1)
            words[at:at] = t
        texts.append(" ".join(words))
    texts.append(LONG + " Released under the MIT License " + LONG)
    rows = [(i, t, "a", "x", 1, 0.5) for i, t in enumerate(texts)] + [(3, texts[4], "a", "x", 1, 0.5), (None, texts[3], "b", None, None, None), (None, None, None, None, None, None)]
    return spark.createDataFrame(rows + rows[3:5] + rows[3:4], SCHEMA).repartition(3).cache()


@pytest.mark.parametrize("threshold", [0.5, 0.9])
def test_license_scan(licensed, threshold):
    rows = licensed.collect()
    want = sorted((str(r.doc_id), len(_words(r.text)), sorted(map(str, _scan(r.text, licenses.NOTICES, licenses.PHRASES, threshold)))) for r in rows)
    got = licenses.scan(licensed, threshold=threshold)
    found = []
    for r in got.collect():
        matches = [(m.label, m.template, m.start, m.end, m.containment, None if m.places is None else tuple(m.places)) for m in r.matches]
        found.append((str(r.doc_id), r.n_words, sorted(map(str, matches))))
    assert sorted(found) == want
    if threshold == 0.9:
        kinds = {m[0] for r in rows for m in _scan(r.text, licenses.NOTICES, licenses.PHRASES, 0.9)}
        assert len(kinds) >= 6 and any(not w[2] for w in want)


def test_license_scan_of_own_templates(licensed, spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert licenses.scan(empty).count() == 0
    nothing = licenses.scan(licensed, {}, {})
    assert nothing.count() == licensed.count() and nothing.where(F.size("matches") > 0).count() == 0
    notices, phrases = {"own": [" ".join(WORDS * 8), "...", "alpha beta"]}, {"it's": ["kappa kappa"]}
    got = {r.doc_id: {str((m.label, m.template, m.start)) for m in r.matches} for r in licenses.scan(licensed, notices, phrases).collect()}
    want = {r.doc_id: {str(m[:3]) for m in _scan(r.text, notices, phrases, 0.9)} for r in licensed.collect()}
    assert licenses.step(notices, phrases) == 80
    assert {k: v for k, v in got.items() if k is not None and k != 3} == {k: v for k, v in want.items() if k is not None and k != 3}
    with pytest.raises(ValueError, match="words"):
        licenses.scan(licensed, {"long": ["word " * (licenses.MAX_TEMPLATE_WORDS + 1)]})


def test_license_scan_stays_native(licensed):
    plan = licenses.scan(licensed)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


# ---- Merkle manifests


def _h(*texts):
    return hashlib.sha256("".join(texts).encode()).hexdigest()


def _tree(leaves):
    """The root, and for each leaf its siblings (before, after) at each level."""
    nodes, proofs = [(h, [i]) for i, h in enumerate(leaves)], [[] for _ in leaves]
    while len(nodes) > 1:
        new = []
        for i in range(0, len(nodes), 16):
            run = nodes[i : i + 16]
            for k, (_, below) in enumerate(run):
                link = ("".join(h for h, _ in run[:k]), "".join(h for h, _ in run[k + 1 :]))
                for leaf in below:
                    proofs[leaf].append(link)
            new.append((_h(*[h for h, _ in run]), [x for _, below in run for x in below]))
        nodes = new
    return nodes[0][0], proofs


def _manifest(rows):
    """{(source, id, leaf, rank): (subroot, root, proof)} of (source, id, leaf) rows."""
    groups = {}
    for source, i, leaf in rows:
        groups.setdefault(source, []).append((i is not None, i, leaf))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in names:
        ordered = sorted(groups[g], key=lambda x: (x[0], x[1] or 0, x[2]))
        trees[g] = (ordered, *_tree([leaf for *_, leaf in ordered]))
    root, above = _tree([trees[g][1] for g in names])
    out = {}
    for g, up in zip(names, above):
        ordered, subroot, proofs = trees[g]
        for rank, ((_, i, leaf), proof) in enumerate(zip(ordered, proofs)):
            out[g, i, leaf, rank] = (subroot, root, proof + up)
    return out


@pytest.mark.parametrize("digits,sizes", [(1, {"a": 700, "b": 16, None: 17, "": 1, "ü": 256, "z": 2}), (3, {"a": 5000, "b": 1}), (2, {"only": 1}), (2, {None: 16})])
def test_manifest(spark, monkeypatch, digits, sizes):
    monkeypatch.setattr(manifest, "BLOCK_DIGITS", digits)
    rng = random.Random(6)
    ids = rng.sample(range(-10_000, 10_000), sum(sizes.values()))
    rows = [(s, ids.pop(), _h(str(rng.random()))) for s, n in sizes.items() for _ in range(n)]
    frame = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "source string, doc_id long, leaf string, rank int").repartition(5)
    got = manifest.manifest(frame.drop("rank"))
    assert got.columns == ["source", "doc_id", "leaf", "rank", "subroot", "root", "proof"]
    found = {(r.source, r.doc_id, r.leaf, r["rank"]): (r.subroot, r.root, [tuple(p) for p in r.proof]) for r in got.collect()}
    assert found == _manifest(rows)
    told = got.select(manifest.fold(F.col("leaf"), "proof").alias("folded"), "root", manifest.fold(F.lit("x"), "proof").alias("other"), F.size("proof").alias("n")).collect()
    assert all(r.folded == r.root and (r.other != r.root or not r.n) for r in told)


def test_manifest_of_awkward_rows(spark):
    schema = "source string, doc_id long, leaf string, rank int, proof string, g string, note array<string>"
    rows = [("s", 1, "x" * 64, 1, "p", "g", ["n"])] * 40 + [("s", None, None, None, None, None, None)] * 3 + [("s", 1, "y" * 64, 1, "p", "g", None), (None, 5, "z", 2, "q", "h", [])]
    frame = spark.createDataFrame(rows, schema).repartition(4)
    got = manifest.manifest(frame, keep=["note"])
    want = _manifest([(r[0], r[1], r[2] or _h("")) for r in rows])
    assert {(r.source, r.doc_id, r.leaf, r["rank"]): (r.subroot, r.root, [tuple(p) for p in r.proof]) for r in got.collect()} == want
    assert sorted(str(r.note) for r in got.collect()) == sorted(str(r[6]) for r in rows)
    assert manifest.manifest(frame.limit(0)).count() == 0
    with pytest.raises(ValueError, match="map"):
        manifest.manifest(frame.withColumn("m", F.create_map(F.lit(1), F.lit(2))), keep=["m"])


def test_leaf_digest(spark):
    frame = spark.sql("SELECT 7L AS a, 'é' AS b, CAST(NULL AS STRING) AS c, '' AS d")
    assert frame.select(manifest.leaf_digest(*map(F.col, "abcd"))).first()[0] == _h("1:7", "2:é", "-", "0:")


# ---- centroid clustering


def _floor(x, scale=1024):
    return math.floor(Fraction(x) * scale) if scale & (scale - 1) == 0 else math.floor(scale * x)


def _cluster(rows, k, rounds, dims):
    """(ids and vectors, clusters, distances, centroids), rows in seed order."""
    kept = [(i, tuple(_floor(x) for x in v)) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    centroids = [v for _, v in kept[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centroids))

    for _ in range(rounds):
        owners = [nearest(v)[1] for _, v in kept]
        for j in range(len(centroids)):
            own = [v for (_, v), o in zip(kept, owners) if o == j]
            if own:
                centroids[j] = tuple(sum(x) // len(own) for x in zip(*own))
    return sorted((str(i), nearest(v)[1], nearest(v)[0]) for i, v in kept), [list(c) for c in centroids]


@pytest.fixture(scope="module")
def vectors(spark):
    rng = random.Random(12)
    rows = [(i, [rng.gauss(3 * (i % 4), 1) for _ in range(20)]) for i in range(150)]
    rows += [(200 + i, rows[i][1]) for i in range(10)] + [rows[3], rows[3], (None, rows[5][1]), (None, [0.25] * 20)]
    rows += [(300, None), (301, []), (302, [None] + [1.0] * 19), (303, [float("nan")] * 20), (304, [float("inf")] + [0.0] * 19), (305, [1.0] * 21)]
    rows += [(400 + i, [float(i % 2)] * 20) for i in range(12)]
    return rows, spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<double>, cluster int, v int").repartition(4).cache()


@pytest.mark.parametrize("k,rounds", [(8, 10), (3, 0), (1, 2), (400, 2)])
def test_clustering(vectors, k, rounds):
    rows, frame = vectors
    got = clustering.cluster(frame, k, rounds=rounds, dims=20)
    want, centroids = _cluster(rows, k, rounds, 20)
    assert sorted((str(r.vec_id), r.cluster, r.distance) for r in got.assigned.collect()) == want
    assert got.centroids == centroids
    assert got.inertia == [sum(d for _, c, d in want if c == j) for j in range(len(centroids))]


def test_clustering_of_nothing_and_of_too_much(spark, vectors):
    none = clustering.cluster(vectors[1].limit(0), 8, dims=20)
    assert none.assigned.count() == 0 and none.assigned.columns == ["vec_id", "cluster", "distance"] and none.centroids == []
    assert clustering.cluster(vectors[1], 8, dims=7).assigned.count() == 0
    huge = spark.createDataFrame([(1, [1e12] * 4), (2, [0.0] * 4)], "vec_id long, embedding array<double>")
    with pytest.raises(ValueError, match="too large"):
        clustering.cluster(huge, 2, dims=4)
    alike = spark.createDataFrame([(i, [0.5] * 64) for i in range(20)], "vec_id long, embedding array<float>")
    got = clustering.cluster(alike)
    assert {(r.cluster, r.distance) for r in got.assigned.collect()} == {(0, 0)} and len(got.centroids) == 8


def test_bounds_rule_out_only_what_is_farther():
    rng = np.random.default_rng(1)
    v = rng.integers(-3000, 3000, (500, 64))
    centroids = np.concatenate([v[:30], v[:5] + rng.integers(-1, 2, (5, 64))])
    whole = ((v[:, None].astype(object) - centroids[None]) ** 2).sum(2)
    axes = np.linalg.eigh(np.cov(v.T))[1][:, ::-1][:, :16]
    rotation = clustering.Rotation(v.mean(0), axes)
    cluster, distance = clustering.Nearest(centroids, rotation)(v, *rotation(v.astype(float)))
    assert (cluster == whole.argmin(1)).all() and (distance == whole.min(1)).all()
