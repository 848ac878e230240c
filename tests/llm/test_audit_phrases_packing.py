"""Filter audit, collocations and packing against brute force; classes of rows that share a doc_id."""

import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from barspark.llm import collocations as C
from barspark.llm.filter_audit import MEASURES, filter_interactions
from barspark.llm.ngram_jaccard import jaccard_classes
from barspark.llm.packing import best_fit, packed
from barspark.llm.queries import WORD_TOKENIZER

#: Extra columns have names that the operators use inside.
EXTRA = "n long, mask long, sha string, part string, good string, id long, key long, salt int, shard int, words string, counts int, task int, place int, length string, rank int, block int"
SCHEMA = f"doc_id long, text string, lang string, {EXTRA}"


def table(spark, rows, parts=3):
    return spark.createDataFrame([(*r, 1, 2, "s", "p", "g", 3, 4, 5, 6, "w", 7, 8, 9, "x", 10, 11) for r in rows], SCHEMA).repartition(parts)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    long = " ".join(rng.choice(["Alpha", "beta", "gamma-ray", "delta's"]) + str(rng.randrange(30)) for _ in range(9000))
    plain = " ".join(f"word{k}" for k in range(150))
    texts = [None, "", " \t\n", "one", "One $ two", plain, plain, plain + " &", plain.upper(), "x " * 200, "naïve ☃ 你好 x ’s İstanbul ΣΑΣ a<|endoftext|>b don't 'tis  ﬁne á", long, long + " tail", "", None]
    found = [(k, t, [None, "en", "de", ""][k % 4]) for k, t in enumerate(texts)]
    return found + [(5, plain, "en"), (6, plain, "de"), (None, plain, "en"), (None, "lone", None), (None, "lone", "de")]


def test_filter_audit(spark, rows):
    labels = [(k, k % 2, int(k % 3 == 0)) for k in range(12)] + [(3, 0, 1), (None, 1, 1)]
    good = {k for k, q, _ in labels if q == 1 and k is not None}
    toxic = {k for k, _, t in labels if t == 1 and k is not None}
    smallest = {}
    for k, t, _ in rows:
        if k is not None:
            smallest[t or ""] = min(k, smallest.get(t or "", k))
    masks = defaultdict(list)
    for k, t, lang in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": t in smallest and (k is None or smallest[t] < k)}
        masks[lang or ""].append(({f for f in fails if fails[f]}, k in good, k in toxic))
    want, shapley = {}, Counter()
    for part, docs in masks.items():
        for order in map("".join, itertools.permutations("ABCDE")):
            for step, f in enumerate(order, 1):
                before = set(order[: step - 1])
                here = [d for d in docs if f in d[0] and not d[0] & before]
                want[part, order, step] = [sum(not d[0] & (before | {f}) for d in docs), len(here), sum(f in d[0] and bool(d[0] & before) for d in docs), sum(d[0] == {f} for d in docs), sum(d[1] for d in here), sum(d[2] for d in here)]
                shapley[part, f] += len(here)
    got = filter_interactions(table(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert {(r.part, r.filter_order, r.step): [r[m] for m in MEASURES] for r in got} == want and len(got) == len(want)
    assert all(r.shapley == shapley[r.part, r.filter_order[r.step - 1]] for r in got)
    assert filter_interactions(table(spark, rows).where("false"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).count() == 0


def brute_phrases(rows, least, best):
    f, n, out = defaultdict(Counter), Counter(), {}
    for _, t, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]+", lambda m: m[0].lower(), t or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for m in range(1, 5):
                f[lang].update(tuple(w[i : i + m]) for i in range(len(w) - m + 1))
    for lang, counts in f.items():
        cand = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        longer = defaultdict(int)
        for p, a in cand.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    longer[p[i : i + m]] = max(longer[p[i : i + m]], a)
        scored = []
        for p, a in cand.items():
            if 100 * longer[p] >= 80 * a:
                continue
            score, _, x, y = min((FACTOR * a // (counts[p[:k]] + counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
            scored.append((-score, -a, " ".join(p).encode(), x, y))
        out[lang] = [(lang, k, p.decode(), -a, x, y, n[lang], -s) for k, (s, a, p, x, y) in enumerate(sorted(scored)[:best], 1)]
    return sorted(x for v in out.values() for x in v)


FACTOR = C.FACTOR


@pytest.mark.parametrize("shard", [300, 1 << 18])
def test_collocations(spark, rows, monkeypatch, shard):
    """With one shard and with many, which have to be summed."""
    monkeypatch.setattr(C, "SHARD_WORDS", shard)
    rng = random.Random(8)
    phrases = ["new york city", "New York", "a b c d", "of the", "of", "the", "x", "é ü", "x x x x x"]
    more = [(k, "".join(rng.choice(phrases) + rng.choice([" ", " ", "  ", ", ", "\t", "\n", ". "]) for _ in range(60)), rng.choice(["en", "de", None])) for k in range(60)]
    every = rows[:11] + more + more[:3]
    got = C.collocations(table(spark, every), least=12, best=25)
    assert sorted(tuple(r) for r in got.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()) == brute_phrases(every, 12, 25)
    if shard == 300:
        assert C.shards(table(spark, every)).count() > 10
        assert C.collocations(table(spark, every).where("false")).count() == 0


def test_packing(spark, rows):
    rng = random.Random(2)
    every = rows + [(100 + k, " ".join(rng.choice(["low", "High", "x9", "...", "naïve"]) for _ in range(rng.randrange(1, 90))), "en") for k in range(300)]
    model = Tokenizer.from_file(WORD_TOKENIZER)
    want, most = Counter(), 64
    for k, t, _ in every:
        ids = [*model.encode(t or "", add_special_tokens=False).ids, 1]
        want.update((k, p, s, len(ids[s : s + most]), zlib.crc32(np.array(ids[s : s + most], "<u4").tobytes())) for p, s in enumerate(range(0, len(ids), most)))
    got = packed(table(spark, every), WORD_TOKENIZER, most).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        b.sort()
        assert [o for o, _ in b] == [sum(n for _, n in b[:k]) for k in range(len(b))] and sum(n for _, n in b) <= most
    rooms = []
    for n in sorted((r.length for r in got), reverse=True):  # best fit, piece by piece
        k = min((k for k in range(len(rooms)) if rooms[k] >= n), key=rooms.__getitem__, default=None)
        if k is None:
            rooms.append(most - n)
        else:
            rooms[k] -= n
    assert len(bins) == len(rooms)
    assert packed(table(spark, every).where("false"), WORD_TOKENIZER).count() == 0


def test_best_fit_of_many_pieces():
    """Millions of pieces cost no more than a few."""
    plan = best_fit({n: 10**9 + n for n in range(1, 513)}, 512)
    assert len(plan) < 5000 and sum(p[2] for p in plan) == sum(10**9 + n for n in range(1, 513))


@pytest.mark.parametrize("turn", [0, 1])
def test_classes_of_one_id_on_two_texts(spark, turn):
    a, b = (" ".join(f"{x}{k}" for k in range(40)) for x in "ab")
    rows = [(1, a), (1, b), (2, a + " a"), (3, b + " b"), (4, "alone")]
    rows[:2] = rows[:2][:: 1 - 2 * turn]
    got = jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(1, 1), (1, 1), (2, 1), (3, 1), (4, 4)]
