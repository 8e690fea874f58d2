"""Chat formatting, embeddings, external suffix sorting, token pieces, components, pipeline and registration."""

import hashlib
import os
import random
import re
from array import array

import numpy as np
import pytest

pytest.importorskip("loamline.llm")

from loamline.llm import chat, common, embedding_dup, entries, external_sort, tokens  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_template_round_trip():
    t = chat.ChatTemplate()
    rng = random.Random(1)
    bits = t.controls() + ["\\", "\\0;", "a", "é", "\n", "<", "[", "</s", "s>", ";"]
    for _ in range(2000):
        turns = [(rng.choice(["system", "user", "assistant", "", "tool", "[AS]", "x\\"]), "".join(rng.choice(bits) for _ in range(rng.randint(0, 8))))
                 for _ in range(rng.randint(0, 4))]
        assert t.parse("".join(s for turn in turns for s, _ in t.segments(*turn))) == turns


def test_chat(spark):
    rows = [(1, 0, "system", "s", 9), (1, 1, "user", "u", 9), (1, 2, "assistant", "é </s>", 9), (2, 0, "assistant", "early", 9), (3, 5, "user", None, 9),
            (3, 5, None, "x", 9), (4, 0, "user", "q", 9), (4, 1, "assistant", "", 9), (4, 1, "assistant", "", 9), (None, None, "user", "n", 9)]
    rows += [(7, k, "user" if k % 2 == 0 else "assistant", f"turn {k}", 9) for k in range(3000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, loss int").repartition(4)
    got = {r["conv_id"]: r for r in chat.digest_segments(chat.format_turns(df)).collect()}
    for c in {r[0] for r in rows}:
        mine = sorted(((t, role or "", text or "") for i, t, role, text, _ in rows if i == c), key=lambda x: (x[0] is not None, x[0], *x[1:]))
        said = "".join(x for _, role, x in mine if role == "assistant")
        whole = "".join(f"{role}\n{x}\n" for _, role, x in mine)
        r = got[c]
        assert (r["n_turns"], r["loss_chars"]) == (len(mine), len(said))
        assert r["loss_sha256"] == hashlib.sha256(said.encode()).hexdigest() and r["turns_sha256"] == hashlib.sha256(whole.encode()).hexdigest()
    assert [c for c in got if got[c]["valid"]] and {c for c in got if got[c]["valid"]} == {1, 7}
    assert chat.digest_segments(chat.format_turns(df.limit(0))).count() == 0


def test_embeddings(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(40, 32))
    vectors = [*base, *base[:10], *(base[:20] + 0.05 * rng.normal(size=(20, 32))), *(base[0] + 0.1 * rng.normal(size=(60, 32))), *(2 * base[5:8])]
    rows = [(i, [float(x) for x in v], 1) for i, v in enumerate(vectors)]
    odd = [(900, None, 1), (901, [0.0] * 32, 1), (902, [float("nan")] * 32, 1), (903, [None, 1.0], 1), (904, [], 1), (905, [1.0, 2.0], 1), (906, [float("inf")] + [1.0] * 31, 1)]
    df = spark.createDataFrame(rows + odd + [(None, rows[0][1], 1)], "vec_id long, embedding array<double>, n_links int").repartition(3)
    x = np.array([r[1] for r in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    link = x @ x.T >= 0.9
    low = np.arange(len(x))
    for _ in range(len(x)):
        low = np.array([low[link[i]].min() for i in range(len(x))])
    for block in (1024, 16):
        got = {r["vec_id"]: r for r in embedding_dup.near_vectors(df, embedding_dup.CapRules(block=block)).collect()}
        exact = sum(got[i]["n_links"] == link[i].sum() - 1 for i in range(len(x)))
        assert exact >= 0.97 * len(x)
        assert sum(got[i]["component_id"] == low[i] for i in range(len(x))) >= 0.97 * len(x)
        for i, *_ in odd:
            assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (0, i, True)
        assert got[None]["n_links"] == 0 and got[None]["kept"]
    assert embedding_dup.near_vectors(df.limit(0)).count() == 0


@pytest.mark.parametrize("chunk", [7, 64, 1 << 19])
def test_suffix_order(chunk, monkeypatch):
    monkeypatch.setattr(external_sort, "CHUNK", chunk)
    rng = random.Random(chunk)
    for _ in range(60):
        n, k = rng.randint(1, 200), rng.choice([1, 2, 3, 5, 256])
        text = np.array([rng.randrange(k) for _ in range(n)], np.uint8)
        if rng.random() < 0.3:
            text = np.tile(text[: rng.randint(1, 20)], 20)[:n]
        with external_sort.Scratch(rng.choice([200, 1 << 20])) as scratch:
            order, prefix = (np.array(x).tolist() for x in external_sort.suffix_order(text, 256, scratch, 20))
        t = text.tolist()
        assert order == sorted(range(len(t)), key=lambda i: t[i:])
        for i in range(1, len(t)):
            a, b, m = order[i - 1], order[i], 0
            while m < 20 and max(a, b) + m < len(t) and t[a + m] == t[b + m]:
                m += 1
            assert prefix[i] == m


@pytest.mark.parametrize("limit", [3, 7, 20, 100])
def test_suffix_order_in_memory_equals_the_external_one(limit, monkeypatch):
    rng = np.random.default_rng(limit)
    texts = [rng.integers(0, k, 3000).astype(np.uint8) for k in (1, 2, 256)]
    texts += [np.tile(rng.integers(200, 256, 137).astype(np.uint8), 20), np.concatenate([texts[1][:900], texts[2][:50], texts[1][:900], texts[2][:60]])]

    def ordered(text, memory):
        with external_sort.Scratch(memory) as scratch:
            return [np.array(x).tolist() for x in external_sort.suffix_order(text, 256, scratch, limit)]

    external = [ordered(text, 5000) for text in texts]
    monkeypatch.setattr(external_sort, "_induce", None)  # not needed for a text in memory
    assert [ordered(text, 1 << 20) for text in texts] == external


@pytest.mark.parametrize("name,blanks", [("word_bpe_49k.json", "dropped"), ("byte_bpe_50k.json", "joined")])
def test_pieces_give_the_library_ids(name, blanks):
    public = pytest.importorskip("public_tokenizers")
    rng = random.Random(3)
    texts = ["", " ", "it's 'S don't 12345 __", "É́a İ ΣΑΣ σας <|endoftext|> x<|startoftext|>y", "a  b\t c", "한국어 中文", "\x1c a", "Ǆ ﬁ ẞ"]
    texts += ["a <|ENDOFTEXT|> b", "<|EndOfText|>", "Mixed<|endOfText|>Case <|endoftext|>Word", "<|StartOfText|> A<B c<|STARTOFTEXT|>"]
    texts += ["".join(rng.choice(["<|EndOfText|>", "<|endoftext|>", "<|STARTOFTEXT|>", "<|", "|>", " ", "Ab", "<"]) for _ in range(9)) for _ in range(300)]
    texts += ["".join(rng.choice("aB  \n\té́'s1.,<|ΣĿ\x1dÅ") for _ in range(rng.randint(1, 40))) for _ in range(2000)]
    parts = ["a", "Word", "wörd.", "it's", " ", " ", " ", "\n", "\n", "\n\n", "\t", "\r\n", ".", ",", "...", "!?", "'s", "12", "²", "ß,", "\0", "\xa0", "\xad", "ж", "你", "_", "İ."]
    texts += ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(4000)]
    e = tokens.Encoder(public.path(name), blanks, held_bytes=100_000)
    for k in range(0, len(texts), 100):
        part = texts[k: k + 100]
        assert e.encode(part) == [array("I", x.ids).tobytes() for x in e.library.encode_batch(part, add_special_tokens=False)]


def test_components(spark):
    rng = random.Random(6)
    edges = [(i, i + 1) for i in range(100, 160)] + [(rng.randrange(300, 360), rng.randrange(300, 360)) for _ in range(50)] + [(5, 5), (9, 7), (7, 9)]
    edges += [(1000, k) for k in range(1001, 1100)]
    got = {r["id"]: r["component"] for r in common.connected_components(spark.createDataFrame(edges, "a long, b long"), "test").collect()}
    label = {x: x for e in edges for x in e}
    for _ in label:
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    assert got == {k: v for k, v in label.items() if any(a != b and k in (a, b) for a, b in edges)}


def test_names():
    names = entries.queries()
    assert {int(re.match(r"op(\d+)_", n)[1]) for n in names if n.startswith("op")} == set(range(1, 14)) and "pipeline" in names
    assert set(entries.oracle_sql()) <= set(names)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, SF)
        assert after.columns == docs.columns and after.dtypes == docs.dtypes
        rows = after.collect()
        assert 0 < len(rows) <= before.count()
        before = spark.createDataFrame(rows, docs.schema)
    pieces = corpus_pipeline.STAGES[-1][1](spark, before, SF).collect()
    assert {r["doc_id"] for r in pieces} == {r["doc_id"] for r in rows}
