import random
import re

import pytest
from graphloom.operators import forms

ROWS = [
    (1, "the {x:text}"), (2, "the {a:name} shall {b:text}"), (3, "the {a:text} shall {b:text} within {n:number} days"), (4, "{a:text} of {b:text} of {c:text}"),
    (5, "{w:word} {n:number}"), (6, "the {a:text} shall {b:text}"), (7, "the end"), (8, "a b a"), (9, "{x:text} a {y:text}"), (10, "a {x:text}"),
]


def brute(items, tokens):
    """All ways to match, by plain backtracking; the first has the shortest slots."""
    if not items:
        return [] if not tokens else None
    value, kind = items[0]
    for n in range(1, (len(tokens) if kind == "text" else min(1, len(tokens))) + 1):
        fits = tokens[0].lower() == value if kind is None else kind == "text" or forms.KINDS[kind](tokens[0])
        if fits:
            rest = brute(items[1:], tokens[n:])
            if rest is not None:
                return ([(value, " ".join(tokens[:n]))] if kind else []) + rest
    return None


def best(tokens):
    found = [(-sum(k is None for _, k in forms.items_of(f)), order) for order, f in ROWS if tokens and brute(forms.items_of(f), tokens) is not None]
    return min(found)[1] if found else None


def test_against_backtracking():
    trie, rng = forms.Forms(ROWS), random.Random(5)
    words = ["the", "The", "Buyer", "shall", "of", "within", "30", "days", "a", "b", "end", "pay"]
    hits = 0
    for _ in range(3000):
        tokens = [rng.choice(words) for _ in range(rng.randrange(9))]
        got = trie.best(tokens)
        assert got == best(tokens)
        if got:
            hits += 1
            assert trie.filled(got, tokens) == brute(trie.items[got], tokens)
    assert hits > 500


def test_no_exponential_backtracking():
    trie = forms.Forms([(1, " ".join(f"{{s{i}:text}} a" for i in range(12)) + " end")])
    assert trie.best(["a"] * 2000) is None
    assert trie.best(["b", "a"] * 1000 + ["end"]) == 1
    assert len(trie.filled(1, ["b", "a"] * 1000 + ["end"])) == 12


@pytest.mark.parametrize("bad", ["", "the {x:colour}", "{}"])
def test_refused_forms(bad):
    with pytest.raises(ValueError):
        forms.items_of(bad)


def test_sentences_of_texts(spark):
    table = spark.createDataFrame(ROWS, "form long, pattern string")
    texts = spark.createDataFrame([(1, "The Buyer shall pay. the end\nArticle 7! A sum of one of many"), (2, None), (3, ""), (4, "nothing here fits, at all? No."), (4, "the end")], "id int, text string")
    got = sorted((r.id, r.sentence, r.form, dict(r.slots)) for r in forms.match_sentences(texts, "id", "text", table).collect())
    assert got == [
        (1, 0, 2, {"a": "Buyer", "b": "pay"}), (1, 1, 7, {}), (1, 2, 5, {"w": "Article", "n": "7"}), (1, 3, 4, {"a": "A sum", "b": "one", "c": "many"}), (4, 0, 7, {}),
    ]
    assert forms.match_sentences(texts.limit(0), "id", "text", table).count() == 0


def test_phrases_against_brute_force(spark):
    rng = random.Random(1)
    words = ["may", "not", "shall", "Pay", "x", "notx"]
    rules = [(k, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 4))), f"c{k % 4}") for k in range(12)] + [(99, "", "empty")]
    texts = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(12))) if i else None) for i in range(150)]
    got = {r[0]: tuple(r)[1:] for r in forms.classify_phrases(spark.createDataFrame(texts, "id int, text string"), "id", "text", spark.createDataFrame(rules, "rule long, phrase string, class string")).collect()}
    for i, text in texts:
        tokens = (text or "").lower().split()
        want = (None, None, None)
        for rule, phrase, name in rules:
            p = phrase.lower().split()
            at = [k for k in range(len(tokens)) if p and tokens[k : k + len(p)] == p]
            if at:
                want = (name, rule, at[0])
                break
        assert got[i] == want
    assert len(re.findall("c", str(got.values()))) > 50


def test_too_many_rows_are_refused(spark, monkeypatch):
    monkeypatch.setattr(forms, "MOST", 3)
    with pytest.raises(ValueError, match="more than 3"):
        forms.match_sentences(spark.createDataFrame([(1, "x")], "id int, text string"), "id", "text", spark.createDataFrame(ROWS, "form long, pattern string"))
