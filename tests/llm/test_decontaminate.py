import random
import re

import numpy as np

from structsim.llm import decontaminate as D

WORD = re.compile(r"[0-9a-z\x80-\U0010ffff]+")


def items(prose, n=60):
    return [(k, " ".join(prose(random.Random(k).randint(6, 40), 1000 + k)) + ".") for k in range(n)]


def bm25(all_items):
    """Item -> {word: share of the item's own score}, from the formula."""
    words = {i: WORD.findall(t.lower()) for i, t in all_items}
    n, mean = len(words), np.mean([len(w) for w in words.values()])
    have = {w: sum(w in own for own in map(set, words.values())) for own in words.values() for w in own}
    out = {}
    for i, own in words.items():
        raw = {w: np.log1p((n - have[w] + 0.5) / (have[w] + 0.5)) * own.count(w) * 2.2 / (own.count(w) + 1.2 * (0.25 + 0.75 * len(own) / mean)) for w in set(own)}
        out[i] = {w: v / sum(raw.values()) for w, v in raw.items()}
    return out


def test_retrieval_equals_scoring_every_item(prose):
    all_items = items(prose)
    index, share = D.Index(all_items), bm25(all_items)
    docs = []
    for k in range(40):
        words = prose(random.Random(k).randint(0, 600), 50 + k)
        for i in random.Random(k).sample(range(60), 2):
            own = all_items[i][1].split()
            at = random.Random(k + i).randint(0, len(words))
            words[at:at] = own[: random.Random(k * i).randint(1, len(own))]
        docs.append(" ".join(words))
    raw = [d.encode() for d in docs]
    h, before = D.letter_words(np.frombuffer(b"".join(raw), np.uint8), np.append(0, np.cumsum([len(r) for r in raw])))
    for least in (0.3, 0.6, 0.95):
        want = {}
        for k, d in enumerate(docs):
            w = WORD.findall(d)
            for p in range(max(1, -(-len(w) // index.stride) - 1)):
                seen = set(w[p * index.stride : (p + 2) * index.stride])
                for i in share:
                    score = sum(v for t, v in share[i].items() if t in seen)
                    if score >= least - 1e-9:
                        want[k, i] = max(score, want.get((k, i), 0))
        got = index.retrieve(h, before, least)
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want)


def test_contained_items_are_found_and_others_left(table, spark, prose, odd_rows):
    all_items = items(prose)
    bench = spark.createDataFrame([(i, t, "z") for i, t in [*all_items, all_items[0]]] + [(90, None, "z"), (91, " .", "z"), (None, "x y", "z")], "item_id long, text string, lang string")
    clean = [(k, " ".join(prose(300, 7000 + k))) for k in range(20, 40)]
    half = [(50, " ".join(prose(50, 1) + all_items[3][1].split()[: len(all_items[3][1].split()) // 2] + prose(50, 2)))]
    planted = [(60 + k, " ".join(prose(40 * k, k)) + "\n" + all_items[k][1].upper() + "\n" + " ".join(prose(90, k + 1))) for k in range(12)]
    docs = table([*odd_rows, *clean, *half, *planted, planted[0]])
    got = D.find_items(docs, bench).collect()
    assert sorted((r["doc_id"], r["item_id"]) for r in got) == sorted([(60 + k, k) for k in range(12)] + [(60, 0)])
    assert sorted((r["doc_id"], r["item_id"]) for r in D.find_items(docs, bench, shard_bytes=2000).collect()) == sorted((r["doc_id"], r["item_id"]) for r in got)
    kept = D.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(d) for d, *_ in [*odd_rows, *clean, *half])
    assert D.find_items(docs, bench.limit(0)).count() == 0 and D.find_items(table([]), bench).count() == 0


def test_scores_do_not_depend_on_shards(table, spark, prose):
    """Part of each item's words, so that scores lie below 1, and a word in all items but few shards' statistics."""
    all_items = [(i, t if i % 9 else f"rareword {t}") for i, t in items(prose)]
    bench = spark.createDataFrame([*all_items, (91, " .")], "item_id long, text string")
    docs = table([(k, " ".join([*prose(30, k), *t.split()[1:], *prose(30, k + 1)])) for k, t in all_items])
    rows = lambda most: sorted((r["doc_id"], r["item_id"], round(r["score"], 9)) for r in D.find_items(docs, bench, 0.3, 0.5, most).collect())
    whole = rows(D.SHARD_BYTES)
    assert rows(5000) == whole and len(whole) > 40 and any(0.3 < s < 0.99 for *_, s in whole)


def test_questions_and_answers():
    assert D.split_item("What is it? A cat.") == ("What is it? ", "A cat.")
    assert D.split_item("Say it. Answer: blue") == ("Say it. Answer: ", "blue")
    assert D.split_item("one two three four five six") == ("one two three four ", "five six")
    assert D.split_item("") == ("", "")


def test_copies_with_one_edit_are_found(table, spark, prose):
    """A word changed, left out or put in at any place, in short and long items without marks."""
    all_items = [(k, " ".join(prose(n, 3000 + k)) + ".") for k, n in enumerate((12, 15, 15, 28, 45))]
    bench = spark.createDataFrame(all_items, "item_id long, text string")
    rows, want = [], []
    for i, text in all_items:
        words = text.split()
        for at in range(len(words)):
            for new in (["zzqx"], [], ["zzqx", words[at]]):
                rows.append((len(rows), " ".join([*prose(20, at), *words[:at], *new, *words[at + 1 :], *prose(30, at + 1)])))
                want.append((len(want), i))
    half = [(10_000 + i, " ".join([*prose(30, i), *text.split()[: len(text.split()) * 2 // 3], *prose(30, i + 1)])) for i, text in all_items]
    got = D.find_items(table([*rows, *half]), bench).collect()
    assert sorted((r["doc_id"], r["item_id"]) for r in got) == want
    assert sorted(r["doc_id"] for r in D.drop_contaminated(table([*rows, *half]), bench).collect()) == [d for d, _ in half]


def test_marked_items_keep_both_parts():
    """With marks, a question alone is no copy of the item."""
    question, answer = "which of the seven rivers is the longest one of all?", "the river that nobody has ever measured to the end"
    index = D.Index([(1, f"{question} {answer}"), (2, "another item of other words to set the weights of terms apart")])
    raw = [f"{question} {answer}".encode(), f"{question} the river that somebody once measured to the sea".encode()]
    found = D.contained(index, np.frombuffer(b"".join(raw), np.uint8), np.append(0, np.cumsum([len(r) for r in raw])), 0.3, 0.8)
    assert [(r[0], r[1]) for r in found] == [(0, 1)]
