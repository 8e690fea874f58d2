"""Manifest, filter audit and sharding against brute force, with nulls, repeats, ties, long texts and clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest

pytest.importorskip("loamline.llm")

from pyspark.sql import functions as F  # noqa: E402

from loamline.llm import filter_audit, merkle, sharding  # noqa: E402
from loamline.llm.ordering import numbered  # noqa: E402

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, part string, idx long, n int, uid long, place int, "
          "words string, mask int, shard string, slot string, members string, `first` long")
EXTRA = ("p", 7, 8, 9, 10, "w", 11, "s", "t", "m", 12)


def rows(seed=3, n=230):
    rng = random.Random(seed)
    words = [a + b for a in "Ka to MI ru sen".split() for b in "lo ne vi tash OR #x é".split()]
    texts = [None, "", " \t\n", "A", "É", "one # two", " ".join(["same"] * 120), "LOUD " * 40, "x" * 200_000]
    texts += [" ".join(rng.choice(words) for _ in range(rng.choice([3, 90, 110, 130]))) for _ in range(60)]
    out = [(i, rng.choice(texts), rng.choice(["en", "de", "de", "de", None, "", "한"]), rng.choice(["web", "web", "web", "web", "code", None, ""]),
            rng.choice([None, i]), *EXTRA) for i in range(n)]
    out += [(1000 + k, texts[20], "hot", "web", 1, *EXTRA) for k in range(90)]  # copies of one text
    out += [out[5]] * 40 + [(None, "no id", "de", "web", None, *EXTRA)] * 3 + [(None, None, None, None, None, *EXTRA), (-4, "minus", "solo", "rare", 2, *EXTRA)]
    rng.shuffle(out)
    return out


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(doc, text, lang, source, n_chars):
    put = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    return h(*map(put, (doc, source, lang, n_chars, text)))


def levels(nodes):
    out = [nodes]
    while len(nodes) > 1:
        nodes = [h(*nodes[a: a + 8]) for a in range(0, len(nodes), 8)]
        out.append(nodes)
    return out


def beside(tree, at):
    """(slot, siblings) of each level that has several nodes."""
    out = []
    for nodes in tree[:-1]:
        run = nodes[at - at % 8: at - at % 8 + 8]
        out.append((at % 8, run[: at % 8] + run[at % 8 + 1:]))
        at //= 8
    return out


def manifest_of(data):
    groups = defaultdict(list)
    for doc, text, lang, source, n_chars, *_ in data:
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text) if text is not None else None
        hit = doc is not None and zlib.crc32(str(doc).encode()) % 3 == 0
        groups[lang].append((doc is not None, doc or 0, leaf(doc, text, lang, source, n_chars), leaf(doc, lower if hit else text, lang, source, n_chars)))
    names = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for x in names:
        groups[x].sort()
        trees[x] = levels([r[2] for r in groups[x]])
    crown = levels([trees[x][-1][0] for x in names])
    out = []
    for k, x in enumerate(names):
        for at, (known, doc, digest, present) in enumerate(groups[x]):
            path = beside(trees[x], at) + beside(crown, k)
            acc = present
            for slot, near in path:
                acc = h(*near[:slot], acc, *near[slot:])
            out.append((doc if known else None, digest, trees[x][-1][0], crown[-1][0], h(*[d for _, near in path for d in near]), acc, acc == crown[-1][0]))
    return out


def test_manifest(docs):
    got = [tuple(r) for r in merkle.verified(docs).collect()]
    want = manifest_of([tuple(r) for r in docs.collect()])
    assert Counter(got) == Counter(want)
    assert {r[-1] for r in got} == {True, False}


@pytest.mark.parametrize("n", [1, 2, 8, 9, 65])
def test_manifest_sizes(spark, n):
    data = [(i, f"T{i}", "en", "s", i, *EXTRA) for i in range(n)]
    got = [tuple(r) for r in merkle.verified(spark.createDataFrame(data, SCHEMA)).collect()]
    assert sorted(got) == sorted(manifest_of(data))


def test_binary_manifest(spark):
    data = [(i, f"T{i}", "en" if i < 5 else "de", "s", i, *EXTRA) for i in range(12)]
    got = merkle.manifest(spark.createDataFrame(data, SCHEMA), fanout=2)
    one = got.withColumn("up", merkle.fold(F.col("leaf"), F.col("path"))).collect()
    assert len(one) == 12 and len({r["root"] for r in one}) == 1 and all(r["up"] == r["root"] for r in one)
    assert all(len(s["members"]) <= 2 for r in one for s in r["path"])
    with pytest.raises(ValueError):
        merkle.manifest(got, fanout=1)


def test_empty(none, spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert merkle.verified(none).collect() == []
    assert filter_audit.filter_audit(none, labels).collect() == []
    assert sharding.assign(none).collect() == []


def audit_of(data, labels):
    fails = []
    first = {}
    for doc, text, *_ in data:
        if doc is not None:
            first[text or ""] = min(doc, first.get(text or "", doc))
    for doc, text, lang, *_ in data:
        t = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        mine = {"A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t),
                "D": bool(re.search("[#$%&*|]", t)), "E": doc is not None and first[t] < doc}
        fails.append((lang or "", {k for k, v in mine.items() if v}, any(q == 1 for i, q, _ in labels if i == doc and doc is not None),
                      any(x == 1 for i, _, x in labels if i == doc and doc is not None)))
    out, shap = {}, Counter()
    for part in {f[0] for f in fails}:
        for order in permutations("ABCDE"):
            left = [f for f in fails if f[0] == part]
            for step, x in enumerate(order, 1):
                gone = [f for f in left if x in f[1]]
                every = [f for f in fails if f[0] == part and x in f[1]]
                left = [f for f in left if x not in f[1]]
                shap[part, x] += len(gone)
                out[part, "".join(order), step] = (len(left), len(gone), len(every) - len(gone), sum(f[1] == {x} for f in every),
                                                   sum(f[2] for f in gone), sum(f[3] for f in gone))
    return {k: (*v, shap[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


LABELS = [(i, i % 3 % 2, int(i % 5 == 0)) for i in range(0, 1100, 2)] + [(4, 1, None), (4, 0, 1), (None, 1, 1), (99_999, 1, 1), (1001, None, None)]


@pytest.mark.parametrize("range_rows", [1 << 17, 16])
def test_audit(spark, docs, range_rows):
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    got = {tuple(r[:3]): tuple(r[3:]) for r in filter_audit.filter_audit(docs, labels, range_rows=range_rows).collect()}
    assert got == audit_of([tuple(r) for r in docs.collect()], LABELS)


def test_galloping():
    rng = np.random.default_rng(1)
    for n, m in [(0, 0), (0, 5), (5, 0), (3, 20_000), (20_000, 3), (5000, 7000)]:
        a, b = (np.unique(rng.integers(0, 30_000, k)) for k in (n, m))
        assert (filter_audit.held(a, b) == np.isin(a, b)).all()
        assert (filter_audit.gallop(a, b) == np.searchsorted(b, a)).all()
        assert (filter_audit.merged(a, b, a[::2]) == np.union1d(a, b)).all()


def shards_of(data, rules=sharding.ShardRules()):
    strata = defaultdict(list)
    for doc, text, _, source, *_ in data:
        raw = (text or "").encode()
        key = hashlib.md5(f"{rules.seed}|{'-' if doc is None else doc}|".encode() + raw).digest()
        strata[source].append((key, doc is not None, doc or 0, len(raw) + 16, zlib.crc32(raw)))
    order = []
    for k, x in enumerate(sorted(strata, key=lambda x: (x is not None, (x or "").encode()))):
        for r, row in enumerate(sorted(strata[x])):
            order.append(((r + 0.5) / len(strata[x]), k, r, row))
    out, slots = [], Counter()
    for at, (_, _, _, (_, known, doc, size, crc)) in enumerate(sorted(order)):
        s = at * rules.shards // len(order)
        out.append((doc if known else None, size, crc, "rows", s, slots[s], None))
        slots[s] += 1
    return out


def test_shards(docs):
    data = [tuple(r) for r in docs.collect()]
    got = [tuple(r) for r in sharding.assign(docs).collect()]
    assert Counter(got) == Counter(shards_of(data))
    sizes = Counter(r[4] for r in got)
    assert max(sizes.values()) - min(sizes.values()) <= 1 and set(sizes) == set(range(40))


def test_mixture(spark):
    data = [(i, f"t{i}", "en", "web" if i % 10 < 7 else "code" if i % 10 < 9 else None, 1, *EXTRA) for i in range(4000)]
    df = spark.createDataFrame(data, SCHEMA)
    rules = sharding.ShardRules(shards=16)
    got = sharding.assign(df, rules).join(df.select("doc_id", "source"), "doc_id").groupBy("shard", "source").count().collect()
    share = {"web": 0.7, "code": 0.2, None: 0.1}
    assert len(got) == 48 and all(abs(r["count"] - 250 * share[r["source"]]) <= 2 for r in got)


def test_few_rows_and_bad_rules(spark):
    data = [(i, "same", "en", "web", 1, *EXTRA) for i in range(3)]
    got = sharding.assign(spark.createDataFrame(data, SCHEMA)).collect()
    assert len({r["shard"] for r in got}) == 3 and {r["slot"] for r in got} == {0}
    with pytest.raises(ValueError):
        sharding.ShardRules(shards=0)


def test_written_shards(spark, docs, tmp_path):
    folder = f"{tmp_path}/shards"
    sharding.write_shards(docs, folder)
    back = spark.read.parquet(folder)
    key = ["doc_id", "text", "lang", "source", "n_chars"]
    assert Counter(tuple(r) for r in back.select(*key).collect()) == Counter(tuple(r) for r in docs.select(*key).collect())
    want = Counter((r[0], r[4], r[5]) for r in shards_of([tuple(r) for r in docs.collect()]))
    assert Counter((r["doc_id"], r["shard_id"], r["shard_slot"]) for r in back.collect()) == want


def test_numbered(spark):
    rng = random.Random(2)
    data = [(rng.choice("aab"), rng.randint(0, 5), k, "x") for k in range(3000)]
    df = spark.createDataFrame(data, "g string, o long, uid long, part string").repartition(6)
    got = {r["uid"]: (r["idx"], r["n"]) for r in numbered(df, "g", ["o", "uid"], "t").collect()}
    for g in "ab":
        mine = sorted((o, u) for x, o, u, _ in data if x == g)
        assert all(got[u] == (k, len(mine)) for k, (_, u) in enumerate(mine))
