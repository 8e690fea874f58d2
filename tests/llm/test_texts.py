"""Operators on documents: brute force, defined cases, clashing columns, empty tables."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("loamline.llm")

from loamline.llm import decontaminate, line_dedup, near_dup, packing, pii, quality, simple8b, suffix_dedup  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, row_key string, `_line_kept` int, sig string, n_chars long"
WORDS = [a + b for a in "ka to mi ru sen dol pra".split() for b in "lo ne vi tash or".split()]


def _text(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def corpus(seed=1):
    rng = random.Random(seed)
    base = [_text(rng, rng.randint(30, 90)) for _ in range(20)]
    texts = [None, "", " \t\n", "one", "One", "two words", "\n\n\n", "é ü ß 한국 x"] + base + base[:5]
    for t in base[:8]:  # near copies: one word changed
        w = t.split()
        w[rng.randrange(len(w))] = "changed"
        texts.append(" ".join(w))
    shared = _text(rng, 40)
    texts += [_text(rng, 15) + " " + shared + " " + _text(rng, 15) for _ in range(6)]
    texts += [base[3] + "\n" + base[4], "\n".join([_text(rng, 12)] * 4), "a" * 700, "ab" * 400, _text(rng, 30_000), "z\n" * 3000]
    rows = [(i, t, "xx", "k", 1, "s", len(t or "")) for i, t in enumerate(texts)]
    return rows + [rows[20], (None, base[0], "xx", None, None, None, 3), (None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect() if r["doc_id"] is not None}


def shingles(text, size):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i: i + size]) for i in range(max(len(w) - size + 1, min(len(w), 1)))}


def components(sets, percent=80):
    label = {k: k for k in sets}

    def root(k):
        while label[k] != k:
            k = label[k]
        return k

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                label[max(x, y)] = min(x, y)
    return {k: root(k) for k in sets}


@pytest.mark.parametrize("size", [2, 5])
@pytest.mark.parametrize("all_pairs", [2, 32])
def test_near_duplicates(docs, size, all_pairs):
    rules = near_dup.NearDupRules(shingle=size, all_pairs=all_pairs)
    rows = near_dup.near_duplicates(docs, rules).collect()
    sets = {r[0]: shingles(r[1], size) for r in corpus() if r[0] is not None}
    want = components(sets)
    assert len(rows) == len(corpus())
    for r in rows:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(sets[r["doc_id"]]), want[r["doc_id"]], want[r["doc_id"]] == r["doc_id"])


def test_keep_one_keeps_columns(docs):
    kept = near_dup.keep_one(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    want = components({r[0]: shingles(r[1], 2) for r in corpus() if r[0] is not None})
    assert sorted(i for i in ids if i is not None) == sorted([k for k in want if want[k] == k] + ([20] if want[20] == 20 else []))


def test_near_duplicates_in_large_groups(spark):
    # a family in which most members are similar to their neighbours only
    words = [f"w{k}" for k in range(400)]
    rows = [(i, " ".join(words[3 * i: 3 * i + 120])) for i in range(80)]
    rows += [(100 + i, " ".join(random.Random(i).sample(words, 60))) for i in range(30)]
    got = by_id(near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), near_dup.NearDupRules(all_pairs=3)))
    want = components({i: shingles(t, 2) for i, t in rows})
    assert {k: r["component_id"] for k, r in got.items()} == want


def line_brute(rows, least=10):
    rows = sorted({(r[0] is not None, r[0] or 0, r[1]) for r in rows if r[1] is not None}, key=lambda r: (r[0], r[1]))
    seen, lines, out = {}, [], {}
    for known, doc, text in rows:
        kept = []
        for line in text.split("\n"):
            w = tuple(x for x in re.split("[ \t\x0b\f\r]+", line.lower()) if x)
            if w and w not in seen:
                near = len(w) >= least and any(len(w) >= least and one_edit(w, v) for v in lines if len(v) >= least)
                seen[w] = not near
                lines.append(w)
                if not near:
                    kept.append(line)
            elif not w:
                kept.append(line)
        out[(known, doc)] = "\n".join(kept)
    return out


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if abs(len(a) - len(b)) != 1:
        return False
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def test_line_dedup(docs):
    got = line_dedup.dedup_lines(docs)
    assert got.columns == docs.columns
    want = line_brute(corpus())
    for r in got.collect():
        if r["text"] is not None and r["doc_id"] is not None:
            assert r["text"] == want[(True, r["doc_id"])] and r["n_chars"] == len(r["text"])


def test_line_edits(spark):
    rng = random.Random(4)
    lines = []
    for _ in range(25):
        w = [rng.choice(WORDS) for _ in range(rng.randint(8, 14))]
        lines.append(w)
        for _ in range(4):
            v, p = list(w), rng.randrange(len(w))
            kind = rng.randrange(4)
            if kind == 0:
                v[p] = rng.choice(WORDS)
            elif kind == 1:
                del v[p]
            elif kind == 2:
                v.insert(p, rng.choice(WORDS))
            else:
                v[p], v[p - 1] = v[p - 1], v[p]
            lines.append(v)
    rng.shuffle(lines)
    rows = [(i, "\n".join(" ".join(w) for w in lines[5 * i: 5 * i + 5])) for i in range(25)]
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    want = line_brute([(i, t) for i, t in rows])
    assert {r["doc_id"]: r["text"] for r in got.collect()} == {k[1]: v for k, v in want.items()}


def passage_brute(rows, length):
    docs = sorted({(r[0] is not None, r[0] or 0, r[1] or "") for r in rows})
    seen, out = set(), {}
    for known, doc, text in docs:
        b = text.encode()
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if b[p: p + length] in seen:
                gone[p: p + length] = b"\1" * length
            seen.add(b[p: p + length])
        rest = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.setdefault((known, doc), []).append((len(b), sum(gone), spans, hashlib.sha256(rest).hexdigest()))
    return out


@pytest.mark.parametrize("rules", [suffix_dedup.PassageRules(), suffix_dedup.PassageRules(hot=1, memory=1 << 10, slice_bytes=3000),
                                   suffix_dedup.PassageRules(length=40, piece=10, bits=1 << 8)])
def test_passages(docs, rules):
    want = passage_brute(corpus(), rules.length)
    for r in suffix_dedup.dedup_passages(docs, rules).collect():
        if r["doc_id"] is not None:
            assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) in want[(True, r["doc_id"])]


def test_decontamination(spark, docs):
    rows = corpus()
    w = rows[10][1].split()
    items = [(1, " ".join(w[4:20])), (2, "two words"), (3, ""), (4, None), (5, "no such thing as this"), (6, "one"), (6, "a" * 700), (None, w[0]),
             (7, ("x " * 30).strip()), (8, " ".join(w[10:25] + ["apart"] + w[30:])), (8, " ".join(w[2:22]))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    words = lambda t: pattern.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = {}
    for i, t in items:
        x = words(t)
        for p in range(max(len(x) - 9, min(len(x), 1))):
            windows.setdefault(tuple(x[p: p + 10]), set()).add(i)
    for block in (1 << 20, 60):
        for r in decontaminate.contamination(docs, bench, block_bytes=block).collect():
            if r["doc_id"] is None:
                continue
            x = words(rows[r["doc_id"]][1])
            hit, found = set(), set()
            for size in {len(k) for k in windows}:
                for p in range(len(x) - size + 1):
                    if tuple(x[p: p + size]) in windows:
                        hit.update(range(p, p + size))
                        found |= windows[tuple(x[p: p + size])]
            names = ",".join(sorted(str(i) for i in found if i is not None))
            assert (r["n_words"], r["n_hit"], r["contaminated"], r["items_sha256"]) == (len(x), len(hit), bool(hit), hashlib.sha256(names.encode()).hexdigest())
            best = {}
            for i, t in items:
                y = words(t)
                table = {}
                for q in range(len(y)) if i in found and i is not None else ():
                    for p in range(len(x)):
                        if x[p] == y[q]:
                            k = table[p, q] = table.get((p - 1, q - 1), 0) + 1
                            if k >= min(10, len(y)):
                                best[str(i)] = min(best.get(str(i), (0, 0, 0)), (-k, p - k + 1, q - k + 1))
            assert {m["item"]: (-m["words"], m["start"], m["item_start"]) for m in r["matches"]} == best
        clean = decontaminate.decontaminate(docs, bench, block_bytes=block)
        assert clean.columns == docs.columns and 10 not in {r["doc_id"] for r in clean.collect()}
    assert decontaminate.decontaminate(docs, bench.limit(0)).count() == len(rows)


def test_longest_match_over_chunks(monkeypatch):
    """Matches that go on over the borders of what is looked at together."""
    rng = random.Random(5)
    items = [(str(k), " ".join(rng.choice("ab") for _ in range(40))) for k in range(6)]
    texts = [" ".join(rng.choice("ab") for _ in range(60)) + " " + t + " c " + t[:30] for _, t in items]
    windows = decontaminate.Windows(items, 4)
    want = list(decontaminate._hits(windows, texts))
    for pairs in (1, 7, 50):
        monkeypatch.setattr(decontaminate, "PAIRS", pairs)
        assert list(decontaminate._hits(windows, texts)) == want
    assert all(want[k][2][str(k)][0] >= 40 for k in range(6))


def test_personal_data_patterns():
    text = "mail a.b+c@x-y.example.org, @no @a.b c@d.e@f.g 1.2.3.4 999.1.1.1 1.2.3.4.5.6.7.8 4111 1111 1111 1111 4111-1111-1111-1112 +1 (212) 555-0123 +12 é x@é.com"
    plain = {
        0: r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", 1: r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        2: r"[0-9]([\x20-]?[0-9])+", 3: r"\+[0-9][\x20().0-9-]+[0-9]"}
    rng = random.Random(2)
    alphabet = "a1@.+-() 4é%,0"
    for t in [text, "", "@", "1" * 4000, "a" * 4000 + "@", *["".join(rng.choice(alphabet) for _ in range(60)) for _ in range(3000)]]:
        want = []
        for kind, p in plain.items():
            for m in re.finditer(p, t):
                digits = re.sub("[^0-9]", "", m[0])
                if kind == 1 and any(int(x) > 255 for x in m[0].split(".")):
                    continue
                if kind == 2 and not (12 <= len(digits) <= 19 and pii.luhn(digits)):
                    continue
                if kind == 3 and not 9 <= len(digits) <= 15:
                    continue
                want.append((m.start(), kind, m.end()))
        assert pii.base_spans(t) == sorted(want)


def test_disclosing_terms(spark):
    rng = random.Random(3)
    rows = [(i, _text(rng, 40)) for i in range(60)]
    rows += [(100 + i, f"{_text(rng, 3)} Zanzibarist mail bob@corp.example.com {_text(rng, 3)}\n{_text(rng, 5)}") for i in range(3)]
    rows += [(200, None), (201, ""), (None, "bob@corp.example.com Zanzibarist")]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, spans string, near int")
    got = by_id(pii.find(docs))
    assert got[100]["n_email"] == 1 and "term:" in got[100]["spans"]
    assert all(got[i]["spans"] == "" for i in range(60)) and got[200]["spans"] == ""
    clean = pii.sanitise(docs)
    assert clean.columns == docs.columns
    texts = {r["doc_id"]: r["text"] for r in clean.collect()}
    assert all("Zanzibarist" not in texts[100 + i] and "[EMAIL]" in texts[100 + i] and "[TERM]" in texts[100 + i] for i in range(3))
    assert texts[200] is None and texts[5] == rows[5][1]


def test_overlapping_spans_are_replaced_together(spark):
    """Nested, crossing, touching and equal spans of all kinds: what no span covers stays, what one covers goes."""
    assert pii.replaced("write bob@10.1.2.3 KEEP THIS TEXT", pii.base_spans("write bob@10.1.2.3 KEEP THIS TEXT")) == "write [EMAIL] KEEP THIS TEXT"
    rng = random.Random(6)
    for _ in range(3000):
        n = rng.randint(0, 30)
        text = "".join(rng.choice("abcdefgh") for _ in range(n))
        spans = []
        for _ in range(rng.randint(0, 5)):
            a = rng.randint(0, max(0, n - 1))
            spans.append((a, rng.randint(0, 4), rng.randint(a, n)))
        spans = [s for s in spans if s[2] > s[0]]
        covered = {i for a, _, b in spans for i in range(a, b)}
        got = pii.replaced(text, spans)
        assert re.sub(r"\[[A-Z]+\]", "", got) == "".join(c for i, c in enumerate(text) if i not in covered)
        runs = sum(1 for i in covered if i - 1 not in covered)
        assert runs <= got.count("[") <= len(spans) and bool(runs) == ("[" in got)
    texts = ["write bob@10.1.2.3 KEEP THIS TEXT", "call +4111 1111 1111 1111 now", "a@b.co,10.0.0.1 +1 (212) 555-0100 10.0.0.256 stays", None, ""]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, _pii_spans string")
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(df).collect()}
    assert clean == {i: pii.replaced(t, pii.base_spans(t)) if t is not None else None for i, t in enumerate(texts)}
    assert "KEEP THIS TEXT" in clean[0] and "4111" not in clean[1] and clean[1].endswith(" now") and "10.0.0.256 stays" in clean[2]
    assert pii.sanitise(df.limit(0)).collect() == []


def test_disclosing_terms_of_whole_documents(spark):
    """Against brute force: far from the entity, on another line, without it, with other letters and repeated rows."""
    rng = random.Random(4)
    rows = [(i, _text(rng, 40)) for i in range(80)]
    rows += [(100 + i, f"mail eve@corp.example.com {_text(rng, 30)} É한 éé Quixotry\n{_text(rng, 9)}\nÜber-Wombatine (x)") for i in range(4)]
    rows += [(200, "nothing but Quixotry and WOMBATINE, quixotry@else.example.org"), (201, None), rows[80], rows[0], rows[0]]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    once = {r: r[1] or "" for r in rows}
    words = {r: {w for w in re.findall(r"[^\x00-@\[-`{-\x7f]{3,}", "".join(c.lower() if c < "\x7f" else c for c in t))} for r, t in once.items()}
    ents = {r: {(k, t[a:b].lower()) for a, k, b in pii.base_spans(t)} for r, t in once.items()}
    told = set()
    for e in set().union(*ents.values()):
        holders = [r for r in once if e in ents[r]]
        for t in set().union(*(words[r] for r in holders)):
            n_te, n_t = sum(t in words[r] for r in holders), sum(t in w for w in words.values())
            pmi = np.log2(n_te * len(once) / (n_t * len(holders)))
            if n_te >= 2 and pmi >= 0.75 * np.log2(len(once) / len(holders)):
                told.add(t)
    assert {"quixotry", "wombatine"} <= told
    got = pii.find(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        text = once[next(x for x in once if x[0] == r["doc_id"])]
        base = pii.base_spans(text)
        want = base + [(m.start(), 4, m.end()) for m in re.finditer(r"[^\x00-@\[-`{-\x7f]{3,}", text)
                       if "".join(c.lower() if c < "\x7f" else c for c in m[0]) in told and not any(a < m.end() and m.start() < b for a, _, b in base)]
        assert r["spans"] == pii.listed(sorted(want)) and r["n_term"] == len(want) - len(base)
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(docs).collect()}
    assert clean[200].startswith("nothing but [TERM] and [TERM], [EMAIL]") and "Quixotry" not in clean[101]


def test_pack_fills_sequences():
    rng = random.Random(5)
    for sizes in ([], [1], [2048], [5000, 1, 1], [rng.randint(1, 6000) for _ in range(200)], [3] * 1000):
        pieces = packing.pack(sizes)
        rows = {}
        for d, start, n, s, offset in pieces:
            rows.setdefault(s, []).append((offset, n))
        for parts in rows.values():
            at = 0
            for offset, n in sorted(parts):
                assert offset == at
                at += n
            assert at == 2048 or at & (at - 1) == 0
        for d, size in enumerate(sizes):
            mine = sorted((start, n) for x, start, n, _, _ in pieces if x == d)
            assert [x for s, n in mine for x in range(s, s + n)] == list(range(size))


def tokenizers(name):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    return public.path(name), Tokenizer.from_file(public.path(name))


def test_packing(docs):
    path, library = tokenizers("byte_bpe_50k.json")
    texts = {r[0]: r[1] or "" for r in corpus()}
    pieces = packing.pack_documents(docs, path).collect()
    covered = {}
    for r in pieces:
        if r["doc_id"] is None:
            continue
        ids = np.array(library.encode(texts[r["doc_id"]], add_special_tokens=False).ids + [1], "<u4")
        assert r["doc_tokens"] == len(ids)
        assert r["ids_crc32"] == zlib.crc32(ids[r["start"]: r["start"] + r["length"]].tobytes())
        covered[r["doc_id"]] = covered.get(r["doc_id"], 0) + r["length"]
    for k, n in covered.items():
        assert n == len(library.encode(texts[k], add_special_tokens=False).ids + [1]) * (2 if k == 20 else 1)


def test_simple8b_round_trip():
    rng = np.random.default_rng(3)
    for n in (0, 1, 7, 60, 5000):
        for top in (1, 2, 3, 100, 50_000, 1 << 30, (1 << 32) - 1):
            ids = rng.integers(0, top, n, endpoint=True).astype(np.uint64)
            words = simple8b.encode(ids)
            assert (simple8b.decode(words) == ids).all()
    docs, firsts, ids = simple8b.unpack_block(simple8b.pack_block([5, None], [np.arange(3, dtype="<u4").tobytes(), b""]))
    assert docs == [5, None] and firsts.tolist() == [0, 3, 3] and ids.tolist() == [0, 1, 2]
    with pytest.raises(ValueError):
        simple8b.unpack_block(b"\0" * 64)


def test_token_blocks(spark, docs, none, tmp_path):
    path, library = tokenizers("word_bpe_49k.json")
    for name, block in (("a", 1 << 18), ("b", 100)):
        simple8b.write_token_blocks(docs, str(tmp_path / name), path, block_ids=block)
        rows = simple8b.read_token_blocks(spark, str(tmp_path / name)).orderBy("start").collect()
        at = 0
        order = [(r[0] is not None, r[0] or 0) for r in ((x["doc_id"],) for x in rows)]
        assert order == sorted(order) and len(rows) == len(corpus())
        texts = {r[0]: r[1] or "" for r in corpus()}
        for r in rows:
            assert r["start"] == at
            at += r["n_tokens"]
            if r["doc_id"] is not None:
                ids = np.array(library.encode(texts[r["doc_id"]], add_special_tokens=False).ids + [1], "<u4")
                assert (r["n_tokens"], r["ids_crc32"]) == (len(ids), zlib.crc32(ids.tobytes()))
    simple8b.write_token_blocks(none, str(tmp_path / "none"), path)
    assert simple8b.read_token_blocks(spark, str(tmp_path / "none")).count() == 0


def test_quality(spark, docs, none):
    rng = random.Random(8)
    good = [(i, _text(rng, 60) + ".") for i in range(300)]
    bad = [(1000 + i, " ".join(rng.choice(WORDS) + "###" for _ in range(40))) for i in range(100)]
    rows = spark.createDataFrame(good + bad, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1 if i < 1000 else 0) for i, _ in good + bad] + [(None, 1), (5, None), (3, 7)], "doc_id long, quality int")
    out = by_id(quality.score_documents(rows, labels))
    for k, r in out.items():
        assert r["held_out"] == (zlib.crc32(str(k).encode()) % 5 == 0)
        assert r["predicted"] == (1 if k < 1000 else 0) and 0 <= r["score"] <= 1
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns
    assert quality.score_documents(docs, labels.limit(0)).count() == len(corpus())
    assert quality.score_documents(none, labels.limit(0)).count() == 0


def test_word_vectors_ignore_task_order(spark, docs):
    a = quality.word_vectors(docs)
    b = quality.word_vectors(docs.repartition(7))
    assert (a[0] == b[0]).all() and (a[1] == b[1]).all()


def test_empty_tables(spark, none):
    bench = spark.createDataFrame([(1, "some words")], "item_id long, text string")
    assert near_dup.near_duplicates(none).count() == 0
    assert line_dedup.dedup_lines(none).count() == 0
    assert suffix_dedup.dedup_passages(none).count() == 0
    assert decontaminate.contamination(none, bench).count() == 0
    assert pii.find(none).count() == 0
    path, _ = tokenizers("byte_bpe_50k.json")
    assert packing.pack_documents(none, path).count() == 0


@pytest.mark.parametrize("length,piece", [(100, 44), (40, 10), (41, 10), (39, 10), (12, 10), (10, 10)])
def test_every_window_holds_a_part(length, piece):
    rules = suffix_dedup.PassageRules(length=length, piece=piece)
    hashes = suffix_dedup.Hashes(np.arange(length, dtype=np.uint8))
    anchor = np.arange(length - piece + 1)  # the piece at every offset of one window
    _, there = suffix_dedup._parts_keys(hashes, np.zeros_like(anchor), np.full_like(anchor, length), anchor, np.zeros(len(anchor), np.uint64), rules)
    assert there.any(axis=1).all()


def test_anchors_follow_content():
    rules = suffix_dedup.PassageRules(length=20, piece=8)
    text = bytes(random.Random(1).choices(b"abc ", k=300))
    data = np.frombuffer(text + b"xyz" + text, np.uint8)
    owner, lo, hi, h, _ = suffix_dedup.anchored(data, np.array([0, 300, 303, 603]), rules)
    first = [(a, b, x) for o, a, b, x in zip(owner, lo, hi, h) if o == 0]
    assert first == [(a - 303, b - 303, x) for o, a, b, x in zip(owner, lo, hi, h) if o == 2]
    assert sum(b - a + 1 for a, b, _ in first) == 281
    assert pa.array(lo).null_count == 0
