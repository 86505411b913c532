"""Weighted sampling, line dedup, search, toxicity, the pipeline."""

import hashlib
import math
import random
import string
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from langatlas.llm import cws, linededup, search, toxicity
from langatlas.llm.common import CLEAN_UP, stage
from langatlas.llm.queries import oracle_sql, queries
from langatlas.session import shared_dir
from tests.llm.helpers import SF, documents, edge_rows, frame, words


# ------------------------------------------------------------ weighted sampling
def jaccard(a, b):
    a, b = Counter(a.lower().split()), Counter(b.lower().split())
    return sum((a & b).values()) / sum((a | b).values())


def test_collision_rate_is_generalised_jaccard():
    sampler = cws.Sampler(4096)
    pairs = [(words(1, 80, 30), words(1, 40, 30) + " " + words(2, 40, 30)),
             ("a a a a b", "a b b b"), ("x y z", "x y z"), ("p q", "r s")]
    for a, b in pairs:
        x, y = sampler.fingerprints([a, b])
        assert abs(cws.likeness(x, y) - jaccard(a, b)) < 0.04


def test_a_full_store_gives_the_same_samples():
    texts = [words(i, 50) for i in range(20)] + ["a a b", ""]
    small = cws.Sampler(32, max_words=5)
    once = np.concatenate([small.fingerprints([t]) for t in texts])
    assert (once == cws.Sampler(32).fingerprints(texts)).all()


@pytest.mark.parametrize("rows", [edge_rows(), documents(), [(3, "alone here")], []],
                         ids=["edge", "given", "one", "none"])
def test_edit_likeness(spark, rows):
    got = cws.edit_likeness(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    if any(i is None for i, _ in rows):      # equal ids are ordered by a hash of the text
        nulls = [r for r in rows if r[0] is None]
        rows = [r for r in rows if r[0] is not None]
        assert len(nulls) == 2
        rows_next = dict(zip([i for i, _ in rows], [t or "" for _, t in rows[1:]]))
        rows_next.pop(rows[-1][0], None)
    else:
        rows_next = dict(zip([i for i, _ in rows], [t or "" for _, t in rows[1:] + rows[:1]]))
    texts, sampler = dict(rows), cws.Sampler()
    for r in got:
        if r["doc_id"] not in rows_next or r["doc_id"] == 20:
            continue
        text = texts[r["doc_id"]] or ""
        edited = cws.edited_text(text, rows_next[r["doc_id"]])
        own, changed, after = sampler.fingerprints([text, edited, rows_next[r["doc_id"]]])
        assert r["n_chars"] == len(text)
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert bytes(r["fp"]) == own.astype(">u2").tobytes()
        assert bytes(r["edited_fp"]) == changed.astype(">u2").tobytes()
        assert r["near_edited"] == cws.likeness(own, changed)
        assert r["near_next"] == cws.likeness(own, after)


# ------------------------------------------------------------------- line dedup
def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, d in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (c != d))
    return row[-1]


def edits(a, b):
    """Levenshtein distance, a column of the table as two big integers."""
    at = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    whole, top = (1 << len(a)) - 1, 1 << len(a) >> 1
    up, down, score = whole, 0, len(a)
    for c in b:
        same = at.get(c, 0)
        flat = ((same & up) + up ^ up) | same | down
        more, less = down | ~(flat | up) & whole, flat & up
        score += bool(more & top) - bool(less & top)
        more, less = (more << 1 | 1) & whole, less << 1 & whole
        up, down = less | ~(flat | more) & whole, more & flat
    return score if a else len(b)


def may_meet(lines):
    """Whether two lines share a key and pass the gate."""
    of, keys = linededup.line_keys([x.encode() for x in lines])
    bands = [set(keys[of == n].tolist()) for n in range(len(lines))]
    fps = linededup.fingerprints([x.encode() for x in lines]).tolist()
    return lambda x, y: (not bands[x].isdisjoint(bands[y])
                         and (max(len(lines[x]), len(lines[y])) < linededup.GATE_CHARS
                              or (fps[x] ^ fps[y]).bit_count() <= linededup.MAX_BITS))


def brute_same_lines(rows, meet=lambda lines: lambda x, y: True):
    """Lines to drop by (id, text), by comparing all different lines that ``meet``:
    lower case and white space collapsed, at most a fifth of the longer one edited; the
    first of a group stays.  Rows with a null id or text count for nothing."""
    places = {}
    for i, text in set(rows):
        if i is None or text is None:
            continue
        row = xxhash.xxh64_intdigest(text.encode(), 42)
        for n, line in enumerate(text.split("\n")):
            folded = " ".join(line.lower().split())
            if any(c.isalnum() or ord(c) > 127 for c in folded):
                places.setdefault(folded, []).append((i, row - (row >> 63 << 64), n, text))
    lines = sorted(places, key=len)
    bags = np.zeros((len(lines), 128), np.int32)
    for k, line in enumerate(lines):
        np.add.at(bags[k], [ord(c) % 128 for c in line], 1)
    sizes, parent = np.array([len(x) for x in lines]), list(range(len(lines)))
    met = meet(lines)

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for x in range(len(lines)):
        end = int(np.searchsorted(sizes, sizes[x] / 0.8 + 1e-6, "right"))
        apart = np.abs(bags[x + 1:end] - bags[x]).sum(axis=1)      # two for a replaced character
        most = (sizes[x + 1:end] * 0.2 + 1e-9).astype(int)
        for y in (np.flatnonzero(apart <= 2 * most) + x + 1).tolist():
            if root(x) != root(y) and met(x, y) and edits(lines[x], lines[y]) <= int(sizes[y] * 0.2 + 1e-9):
                parent[root(y)] = root(x)
    groups, gone = {}, {}
    for k, line in enumerate(lines):
        groups.setdefault(root(k), []).extend(places[line])
    for found in groups.values():
        for i, _, n, text in sorted(found)[1:]:
            gone.setdefault((i, text), set()).add(n)
    return gone


def test_plain_edit_distance():
    r = __import__("random").Random(4)
    for _ in range(400):
        a, b = ("".join(r.choice("abé ") for _ in range(r.randint(0, 12))) for _ in range(2))
        assert edits(a, b) == levenshtein(a, b)


def line_rows():
    a, b = words(1, 30), words(2, 30)
    return [(1, f"{a}\n\n{b}"), (2, f"{a.upper()}!\nown line here"), (3, f"{b} plus\nown  line, here"),
            (4, a), (5, "\n\n"), (6, "1999 items"), (7, "2024 items"), (8, "..."), (9, "..."),
            (10, f"{b}\n{b}"), (11, "漢字 のテキスト\né"), (12, "漢字 のテキスト\nÉ")] + edge_rows()[12:]


def template_rows():
    """Lines of one form with other numbers: any two are about as far apart as the
    similarity allows, and some copies differ in a digit."""
    import random
    r = random.Random(9)
    numbers = r.sample(range(10**7, 10**8), 300)
    return [(n, f"order {x} shipped to gate {x * 7 % 10**8:08d}") for n, x in enumerate(numbers)] + [
        (1000 + n, f"order {x} shipped to gate {x * 7 % 10**8 ^ 1:08d}")
        for n, x in enumerate(numbers[:40])]


def outlier_rows():
    """Many near copies of one line, and one that only some of them are close to."""
    line = words(3, 40).split()
    copies = [(n, " ".join(line[:n % 40] + [f"x{n}"] + line[n % 40 + 1:])) for n in range(400)]
    return copies + [(900, " ".join(line[:30] + words(4, 10).split()))]


def same_id_rows():
    a = "alpha beta gamma delta epsilon"
    return [(1, a), (2, a), (2, "something quite unlike the other one"), (2, a + "\nmore of it"),
            (2, a), (2, "")]


@pytest.mark.parametrize("rows, meet", [
    (line_rows(), None), (documents(), None), (template_rows(), may_meet), (outlier_rows(), may_meet),
    (same_id_rows(), None), ([], None)],
    ids=["edge", "given", "template", "outlier", "same id", "none"])
def test_lines(spark, rows, meet):
    docs = frame(spark, rows)
    got = linededup.dedup_lines(docs, dropped_col="dropped").collect()
    gone = brute_same_lines(rows, meet) if meet else brute_same_lines(rows)
    want = []
    for i, text in rows:
        drop = sorted(gone.get((i, text), ()))
        kept = None if text is None else "\n".join(
            x for n, x in enumerate(text.split("\n")) if n not in drop)
        want.append((i, kept, drop))
    assert sorted(((r["doc_id"], r["text"], r["dropped"]) for r in got), key=str) == sorted(
        want, key=str)
    assert linededup.dedup_lines(docs).columns == docs.columns


def test_stages_go_once_read(spark):
    import glob
    folder = f"{shared_dir(spark)}/stages/"
    before = set(glob.glob(folder + "*"))
    setting = spark.conf.get(CLEAN_UP)
    assert linededup.dedup_lines(frame(spark, template_rows()[:20])).count() == 20
    left = {x[len(folder):].rsplit("-", 1)[0] for x in set(glob.glob(folder + "*")) - before}
    assert not left & {"lines", "line-keys", "line-rows", "line-shared", "line-met", "line-wanted", "line-pairs",
                       "line-texts", "line-rooted", "line-open", "line-held", "cc-least", "cc-large", "cc-small"}
    assert spark.conf.get(CLEAN_UP) == setting


def test_a_stage_takes_its_shuffle_files_along(spark):
    def written():
        return spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles().length()

    import time
    docs = spark.range(0, 5000, 1, 4).groupBy((F.col("id") % 999).alias("k")).count()
    before = written()
    stage(docs, "shuffled")
    for _ in range(50):                              # they go soon after, not at once
        if written() <= before:
            return
        time.sleep(0.1)
    raise AssertionError("shuffle files are left")


def test_copies_of_a_template_go(spark):
    got = linededup.dedup_lines(frame(spark, template_rows())).collect()
    assert all(r["text"] == "" for r in got if r["doc_id"] >= 1000)


def test_hot_keys_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(linededup, "SALT_ROWS", 3)
    test_lines(spark, template_rows(), may_meet)


def test_long_lines(spark, monkeypatch):
    monkeypatch.setattr(linededup, "NATIVE_CHARS", 20)
    monkeypatch.setattr(linededup, "HASH_BLOCK", 64)
    test_lines(spark, line_rows(), None)


def test_fingerprint_of_a_line_does_not_depend_on_its_company(monkeypatch):
    lines = [words(n, 1 + 40 * n).encode() for n in range(12)]
    alone = [int(linededup.fingerprints([x])[0]) for x in lines]
    assert linededup.fingerprints(lines).tolist() == alone
    monkeypatch.setattr(linededup, "HASH_BLOCK", 200)
    assert linededup.fingerprints(lines).tolist() == alone


def edited_pairs():
    """Lines with one typo, three, a word put in, one taken out, one replaced."""
    import random
    r, lines, pairs = random.Random(5), [], {}
    for _, text in documents():
        lines += [x.decode() for x in linededup.compared_lines(text) if x and len(x.split()) >= 4]
    for line in r.sample(sorted({x for x in lines if len(x) < 400}), 150):
        for kind in ("letter", "letters", "in", "out", "word"):
            w, chars = line.split(), list(line)
            i = r.randrange(len(w))
            if kind.startswith("letter"):
                for _ in range(1 if kind == "letter" else 3):
                    spot = r.choice([n for n, c in enumerate(chars) if c != " "])
                    chars[spot] = r.choice("abcdefgh")
                w = "".join(chars).split()
            elif kind == "in":
                w.insert(i, "inserted")
            else:
                w[i:i + 1] = ["replaced"] if kind == "word" else []
            other = " ".join(w)
            most = int(max(len(line), len(other)) * 0.2 + 1e-9)
            if other != line and levenshtein(line, other) <= most:
                pairs.setdefault(kind, []).append((line, other))
    return pairs


def test_bands_and_gate_meet_what_the_edit_distance_keeps():
    for kind, pairs in edited_pairs().items():
        met = 0
        for pair in pairs:
            met += may_meet(pair)(0, 1)
        print(f"{kind}: {met} of {len(pairs)}")
        assert len(pairs) > 100 and met / len(pairs) >= (0.95 if kind == "letters" else 0.98), kind


def test_edited_lines_go(spark):
    pairs = [p for found in edited_pairs().values() for p in found[:12]]
    rows = [(n, f"{a}\n{b}") for n, (a, b) in enumerate(pairs)]
    got = linededup.dedup_lines(frame(spark, rows), dropped_col="dropped").collect()
    assert sum(1 in r["dropped"] for r in got) >= 0.95 * len(rows)


def test_lines_of_other_digits_or_signs_need_the_edit_check(spark):
    rows = [(1, "1999 items\nC\n12.50\ntotal of 1234567 items"), (2, "2024 items\nC++\n99.99"),
            (3, "C#\nTotal  of 1234568 items!\nc"), (4, "so, it goes on and on\n1999 ITEMS"),
            (5, "so it goes on and on")]
    got = linededup.dedup_lines(frame(spark, rows), dropped_col="dropped").collect()
    assert {r["doc_id"]: r["dropped"] for r in got} == {1: [], 2: [], 3: [1, 2], 4: [1], 5: [0]}


def test_distance_is_levenshtein():
    import random
    r = random.Random(2)
    for _ in range(300):
        a = "".join(r.choice("abcé🙂 ") for _ in range(r.randint(0, 90)))
        b = "".join(c if r.random() > .2 else r.choice(["", "x", c + "y"]) for c in a)
        for x, y in ((a, b), (b, a), (a, a[::-1])):
            assert linededup.distance(x, y) == levenshtein(x, y)


# ----------------------------------------------------------------------- search
def brute_search(rows, queries, k=10):
    docs = [(i, Counter(search.words_of(t))) for i, t in rows if i is not None]
    df = Counter(w for _, c in docs for w in c)
    n = len(docs)
    mean = sum(sum(c.values()) for _, c in docs) / n
    out = {}
    for q, text in queries:
        found = []
        for i, c in docs:
            s = sum(m * math.log(1 + (n - df[w] + .5) / (df[w] + .5)) * c[w] * 2.2
                    / (c[w] + 1.2 * (.25 + .75 * sum(c.values()) / mean))
                    for w, m in Counter(search.words_of(text)).items() if w in c)
            if s > 0:
                found.append((-round(s, 7), i))
        out[q] = sorted(found)[:k]
    return out


@pytest.mark.parametrize("rows,params", [
    (documents(), {}), (documents(), {"segment_docs": 70, "block_terms": 300, "k": 3}),
    (edge_rows(), {"segment_docs": 5})], ids=["given", "segments", "edge"])
def test_search_is_exact(spark, rows, params):
    asked = [(i, t) for i, t in rows if i is not None and i != 20 and (i % 50 == 0 or len(rows) < 50)]
    got = search.search(frame(spark, rows), frame(spark, asked), **params).collect()
    want = brute_search(rows, asked, params.get("k", 10))
    for q, best in want.items():
        mine = sorted((r["rank"], -r["score"], r["doc_id"]) for r in got if r["query_id"] == q)
        assert [m[0] for m in mine] == list(range(1, len(best) + 1))
        assert [m[2] for m in mine] == [i for _, i in best] or len({s for s, _ in best}) < len(best)
        assert np.allclose([m[1] for m in mine], [s for s, _ in best])
    assert {r["query_id"] for r in got} == {q for q, best in want.items() if best}


def test_search_of_empty_tables(spark):
    some, none = frame(spark, edge_rows()), frame(spark, [])
    assert search.search(none, some).collect() == []
    assert search.search(some, none).collect() == []


@pytest.mark.parametrize("share, terms", [(1, 5), (10**6, 10**6), (10**6, 3)])
def test_search_is_exact_whatever_is_a_matrix(spark, monkeypatch, share, terms):
    monkeypatch.setattr(search, "DENSE_SHARE", share)
    monkeypatch.setattr(search, "DENSE_TERMS", terms)
    monkeypatch.setattr(search, "BLOCK_DOCS", 4)
    monkeypatch.setattr(search, "QUERY_BATCH", 3)
    rows = [(i, f"{words(i % 40, 12)} {'copy' if i % 3 else 'other'} the the") for i in range(120)]
    asked = rows[::7]
    want = brute_search(rows, asked, 4)
    segments = search.build_index(frame(spark, rows), segment_docs=50)
    hashes, n = search.TermHashes(), len(rows)
    counted = [hashes.counted(t) for _, t in rows]
    df = Counter(x for c in counted for x in c[0].tolist())
    texts = [hashes.counted(t) for _, t in asked]
    weights = [c * np.array([math.log(1 + (n - df[x] + .5) / (df[x] + .5)) for x in t.tolist()])
               for t, c, _ in texts]
    best = [(np.zeros(0, np.int64), np.zeros(0))] * len(asked)
    for row in segments.collect():
        search.Segment(row.asDict(), sum(c[2] for c in counted) / n).search(
            np.cumsum([0] + [len(t[0]) for t in texts]), np.concatenate([t[0] for t in texts]),
            np.concatenate(weights), best, 4)
    for (q, _), (ids, scores) in zip(asked, best):
        assert [(-round(s, 7), i) for i, s in zip(ids.tolist(), scores.tolist())] == want[q]


def test_a_task_returns_the_best_of_all_its_segments(spark, monkeypatch):
    paths = []
    whole = search.scratch_path
    monkeypatch.setattr(search, "scratch_path",
                        lambda spark, name: paths.append(whole(spark, name)) or paths[-1])
    rows = frame(spark, [(i, f"common words {i}") for i in range(60)]).coalesce(1)
    got = search.search(rows, rows.where("doc_id < 4"), k=3, segment_docs=5)
    assert got.count() == 4 * 3
    assert spark.read.parquet(paths[-1]).count() == 4 * 3


# --------------------------------------------------------------------- toxicity
def plain_kernel(u, v):
    def features(w):
        coded, found = [31, *toxicity.coded([w])[0].tolist(), 31], Counter()
        for i in range(len(coded)):
            for j in range(i + 1, len(coded)):
                for k in range(j + 1, min(i + 5, len(coded))):
                    found[coded[i], coded[j], coded[k]] += 0.5 ** (k - i - 2)
        return found
    a, b = features(u), features(v)
    dot = sum(x * b[f] for f, x in a.items())
    return (dot / math.sqrt(sum(x * x for x in a.values()) * sum(x * x for x in b.values()))) ** 4


def test_kernel_is_the_subsequence_kernel():
    units = ["idiot", "idxiot", "idioot", "moron", "aaaa", "été", "x", "trashcan"]
    got = toxicity.Landmarks(units).kernel(units)
    assert np.allclose(got, [[plain_kernel(u, v) for v in units] for u in units], atol=1e-5)
    assert got[0, 1] > 10 * got[0, 3]


def test_units_undo_signs_digits_and_spacing():
    assert toxicity.stretches("1d!o-t") == ["idot"] and toxicity.stretches("...") == []
    assert "idiot" in toxicity.raw_units("such an I d i o t ok")
    long = "".join(chr(97 + i % 26) for i in range(95))
    parts = toxicity.stretches(long)
    assert all(len(p) <= 40 for p in parts) and parts[0] + parts[1][5:] + parts[2][5:] == long


def labelled(n=400):
    bad = ["blorgface", "zankwit", "murgle"]
    rows = [(i, words(i, 40) + (f" {bad[i % 3]} " if i % 5 == 0 else " ") + words(i + 9000, 30) + ".")
            for i in range(n)]
    return rows, [(i, int(i % 5 == 0)) for i in range(n)]


def test_held_out_accuracy(spark):
    rows, labels = labelled()
    docs = frame(spark, rows + [(None, None), (901, ""), (902, None)])
    table = spark.createDataFrame(labels + [(None, 1), (7, None), (5, 1)], "doc_id bigint, toxic int")
    got = toxicity.score_documents(docs, toxicity.train(docs, table)).collect()
    assert len(got) == len(rows) + 3 and all(0 <= r["score"] <= 1 for r in got)
    truth = dict(labels)
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert len(held) > 40
    right = sum(r["predicted"] == truth[r["doc_id"]] for r in held)
    assert right / len(held) > 0.95
    assert {r["predicted"] for r in got if r["doc_id"] in (None, 901, 902)} == {0}


def test_training_ignores_the_held_out_fold(spark):
    rows, labels = labelled(150)
    docs = frame(spark, rows)
    import zlib
    flipped = [(i, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y) for i, y in labels]
    a, b = (toxicity.train(docs, spark.createDataFrame(x, "doc_id bigint, toxic int"))
            for x in (labels, flipped))
    assert (a.landmarks, a.weights, a.sigmoid) == (b.landmarks, b.weights, b.sigmoid)


@pytest.mark.parametrize("labels", [[], [(1, 0)], [(1, 1), (2, 1)]], ids=["none", "clean", "toxic"])
def test_too_few_labels(spark, labels):
    docs = frame(spark, edge_rows())
    model = toxicity.train(docs, spark.createDataFrame(labels, "doc_id bigint, toxic int"))
    assert toxicity.score_documents(docs, model).count() == len(edge_rows())
    none = frame(spark, [])
    assert toxicity.score_documents(none, model).collect() == []
    assert toxicity.keep_clean(none, model).collect() == []


# --------------------------------------------------------------- the registered
def test_registered():
    names = list(queries())
    assert [int(n[2:].split("_")[0]) for n in names] == list(range(1, 14))
    assert set(oracle_sql()) <= set(names)
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "toxicity", "line_dedup", "simhash_near_dedup", "best_fit_packing"]


def test_pipeline_stages(spark):
    from tests.llm.test_simhash import brute
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    clean = stages["toxicity"](spark, docs, SF)
    assert clean.columns == docs.columns
    rows = documents()
    gone = brute_same_lines(rows)
    lined = [(i, "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone.get((i, t), ())))
             for i, t in rows]
    left = stages["line_dedup"](spark, docs, SF)
    assert left.columns == docs.columns
    assert sorted((r["doc_id"], r["text"]) for r in left.collect()) == sorted(lined)
    kept = stages["simhash_near_dedup"](spark, left, SF)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(
        i for i, _, c in brute(lined) if i == c)
    packed = stages["best_fit_packing"](spark, kept, SF)
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == {
        i for i, _, c in brute(lined) if i == c}


def test_pipeline_runs(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 0 and "sequence_id" in out.columns


def test_many_pairs_at_once_keep_what_their_distance_keeps(monkeypatch):
    rnd = random.Random(7)
    one, other, most = [], [], []
    for i in range(600):
        signs = ("ab", "abcdefgh \u00e9\U0001F600", [chr(300 + j) for j in range(400)])[i % 3]
        x = [rnd.choice(signs) for _ in range(rnd.choice([0, 1, 5, 40, 90]))]
        y = list(x)
        for _ in range(rnd.randrange(len(x) // 2 + 2)):
            at = rnd.randrange(len(y) + 1)
            y[at:at + rnd.randrange(2)] = rnd.choice(signs) * rnd.randrange(2)
        one.append("".join(x))
        other.append("".join(y))
        most.append(rnd.choice([0, 1, max(len(x), len(y)) // 5, 300 if i % 50 == 0 else 4]))
    want = [levenshtein(x, y) <= m for x, y, m in zip(one, other, most)]
    for pairs, look in ((2048, 32), (7, 1)):
        monkeypatch.setattr(linededup, "BAND_PAIRS", pairs)
        monkeypatch.setattr(linededup, "BAND_LOOK", look)
        found = linededup.within(pa.array(one), pa.array(other), np.array(most))
        assert found.tolist() == want
    assert 100 < sum(want) < 500


def test_pairs_that_are_put_off_are_decided_together(monkeypatch):
    rnd = random.Random(5)
    line = "".join(rnd.choice("abcdefgh ") for _ in range(120))
    one, other = [line] * 60, ["".join(rnd.choice("abcdefgh ") for _ in range(120)) for _ in range(57)]
    other += [line[:50] + "x" + line[50:], line[3:], line[:60] + line[60:].replace("a", "b")]
    asked = []
    whole = linededup._within_band
    monkeypatch.setattr(linededup, "_within_band",
                        lambda *args: asked.append(len(args[6])) or whole(*args))
    found = linededup.within(pa.array(one), pa.array(other), np.array([24] * 60))
    assert found.tolist() == [levenshtein(x, y) <= 24 for x, y in zip(one, other)]
    assert asked == [60, 3] and found.sum() >= 2


def test_character_counts_bound_the_edits():
    rnd = random.Random(3)
    for _ in range(200):
        x = "".join(rnd.choice("abcdq1. \u00e9\u20ac\U0001F600") for _ in range(rnd.randrange(60)))
        y = "".join(rnd.choice("abcdq1. \u00e9\u20ac\U0001F600") for _ in range(rnd.randrange(60)))
        a, b = linededup.character_counts([x.encode(), y.encode()]).astype(int)
        assert a.sum() == len(x) and b.sum() == len(y)
        assert max(np.maximum(a - b, 0).sum(), np.maximum(b - a, 0).sum()) <= levenshtein(x, y)


def test_texts_are_shuffled_for_a_part_of_the_pairs_at_a_time(spark, monkeypatch):
    staged = []
    whole = linededup.stage

    def counted(df, name, *rest):
        staged.append(name)
        return whole(df, name, *rest)

    monkeypatch.setattr(linededup, "stage", counted)
    rows = [(i, f"this line number {chr(97 + i)} is much like all of the others") for i in range(9)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    kept = [r["text"] for r in linededup.dedup_lines(docs).collect()]
    assert len([t for t in kept if t]) == 1
    assert staged.count("line-same") == 2 * linededup.TEXT_PARTS


def test_lines_of_one_small_stock_of_syllables_seldom_meet():
    rnd = random.Random(11)
    stock = "the on an er re tion st th en in ou es ha ea and of ed nt ly sh ing ble wh".split()
    vocabulary = ["".join(rnd.choice(stock) for _ in range(rnd.randint(1, 3))) for _ in range(3000)]
    lines = [" ".join(rnd.choice(vocabulary) for _ in range(rnd.choice([15, 60]))).encode()
             for _ in range(3000)]
    _, keys = linededup.line_keys(lines)
    pairs = sum(n * (n - 1) // 2 for n in Counter(keys.tolist()).values())
    assert pairs < 300, pairs


@pytest.mark.parametrize("rows", [1, 2, 1000])
def test_meetings(spark, rows):
    rnd = random.Random(rows)
    posts = [(rnd.randrange(60), rnd.randrange(-9, 9)) for _ in range(90)] + [(99, n) for n in range(40)] * 2
    before = spark.conf.get(search.ARROW_ROWS)
    spark.conf.set(search.ARROW_ROWS, str(rows))
    try:
        got = linededup.meetings(spark.createDataFrame(posts, "key bigint, node bigint")).collect()
    finally:
        spark.conf.set(search.ARROW_ROWS, before)
    nodes = {}
    for key, node in posts:
        nodes.setdefault(key, set()).add(node)
    want = [(k, n, min(v), len(v) > 2) for k, v in nodes.items() for n in v if n != min(v)]
    assert sorted(map(tuple, got)) == sorted(want)


def test_pairs_that_match_at_once_are_near():
    rnd, one, other, most = random.Random(2), [], [], []
    for i in range(900):
        signs = ("abcdefgh ij", "abé\U0001F600 ", "a")[i % 3]
        x = [rnd.choice(signs) for _ in range(rnd.randint(0, 160))]
        y = list(x)
        for _ in range(rnd.randrange(6)):
            at = rnd.randrange(len(y) + 1)
            y[at:at + rnd.randrange(20)] = [rnd.choice(signs) for _ in range(rnd.randrange(20))]
        one.append("".join(x))
        other.append("".join(y))
        most.append(rnd.choice([0, 3, max(len(x), len(y)) // 5]))
    found = linededup.matched(pa.array(one), pa.array(other), np.array(most))
    near = np.array([edits(x, y) <= m for x, y, m in zip(one, other, most)])
    assert not (found & ~near).any() and (found & near).sum() > 0.6 * near.sum()


def test_a_segment_is_made_in_little_memory():
    import tracemalloc
    rnd = np.random.default_rng(4)
    found = [np.unique(rnd.integers(0, 200_000, 300).astype(np.uint64)) for _ in range(4000)]
    counted = [(terms, search.TermHashes().counted("a b a")[1][:1].repeat(len(terms))) for terms in found]
    postings = sum(map(len, found))
    tracemalloc.start()
    search._segment(list(range(4000)), [300] * 4000, [c[0] for c in counted], [c[1] for c in counted])
    most = tracemalloc.get_traced_memory()[1] / postings
    tracemalloc.stop()
    assert most < 40, most                           # bytes a posting


def test_words_end_at_signs_and_any_white_space():
    text = "A-b c\x1cd\x85e f\xa0G,h. Été! İx 漢字_y"
    signs = str.maketrans(dict.fromkeys(string.punctuation, " "))
    assert search.words_of(text) == text.lower().translate(signs).split()
    assert search.words_of(None) == []
