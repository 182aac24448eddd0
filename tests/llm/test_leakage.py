import pytest

from codelode.llm import leakage as lk

OPEN = "Read the task with care and answer it. "
PROMPT = "The path from kalmelor to vendural has weight 582, though a stale cluster offers 379 instead. Suppose the ledger called kalmelor loses 869 of its 385 vendural links; the ordered ones go first."
CODE = "def kalmelor_vendural(span, anchor):\n    queue = span * 76 + 806\n    for kal in range(28, anchor):\n        if kal % 6 == 2:\n            queue -= kal // 18\n    return (queue, 'vendural', 806)"


def others():
    """Prompts on the same frame, so its words are common."""
    names = [f"na{c}{d}ro" for c in "bcdfg" for d in "aeiou"]
    return [(100 + i, "s", OPEN + f"The path from {n} to {n[::-1]} has weight {500 + i}, though a lazy queue offers {200 + i} instead. Suppose the voucher called {n} loses {700 + i} of its {300 + i} {n[::-1]} links; the sparse ones go first.", f"It is {i * 17 + 3}.") for i, n in enumerate(names)]


@pytest.fixture(scope="module")
def items():
    return [(1, "s", OPEN + PROMPT, CODE), (2, "s", None, None), (3, None, "", ""), *others()]


@pytest.fixture(scope="module")
def carrier(items):
    return lk.Carrier(items)


def variants():
    w = PROMPT.split()
    return {
        "whole": "x " + PROMPT + " y",
        "upper": PROMPT.upper(),
        "marks": "**" + "** `".join(w) + "`",
        "lines": "> " + "\n> ".join(" ".join(w[i : i + 4]) for i in range(0, len(w), 4)),
        "look-alikes": PROMPT.replace("a", "а").replace("e", "е"),
        "accents": PROMPT.replace("e", "é"),
        "zero width": PROMPT.replace("path", "pa​th").replace("weight", "wei­ght"),
        "swapped letters": PROMPT.replace("cluster", "clsuter").replace("ledger", "legder"),
        "a word changed": PROMPT.replace("though", "while").replace("called", "named"),
        "words added": PROMPT.replace("has", "also has").replace("loses", "really loses"),
        "part": " ".join(w[3:27]),
        "two places": " ".join(w[:13]) + ". Something else entirely stands here for a while, at some length, on another matter. " + " ".join(w[16:30]),
        "escaped": '{"q": "' + PROMPT.replace(". ", ".\\n") + '"}',
        "tags": "<p>" + PROMPT.replace(" ", "&nbsp;", 9) + "</p>",
        "code": "```python\n" + CODE + "\n```",
        "code laid out otherwise": CODE.replace("\n", " ").replace("    ", "\t"),
    }


@pytest.mark.parametrize("kind", sorted(variants()))
def test_found(carrier, kind):
    assert carrier.items_in(variants()[kind]) == {1}


@pytest.mark.parametrize("text", [None, "", OPEN, "One team quoted “" + " ".join(PROMPT.split()[:9]) + "” at length.", PROMPT.replace("kalmelor", "torvan").replace("vendural", "perrik").replace("582", "113").replace("379", "764").replace("869", "22").replace("385", "918").replace("stale cluster", "raw token").replace("ledger", "bucket").replace("ordered", "dense")])
def test_not_found(carrier, text):
    assert carrier.items_in(text or "") == set()


def test_offsets_point_into_the_original(carrier):
    text = "Ünï​cödé x " + PROMPT
    words, at, found, whole = carrier.proposals(text)
    assert text[slice(*at[0])] == "Ünï​cödé" and text[slice(*at[words.index(lk.key("kalmelor"))])] == "kalmelor"
    (item, part, n, share, case, lo, hi) = next(p for p in carrier.passages(text + " z") if p[0] == 1)
    assert text[lo:hi] == PROMPT.rstrip(".") and (part, share, case) == ("prompt", 1.0, True) and n == len(lk.words_of(PROMPT)[0])


SHORT = "Which of seven brass lanterns did the ferryman trade for salt before the long winter?"


def test_a_short_item_is_a_passage_but_no_case():
    c = lk.Carrier([(7, "s", SHORT, "Salt."), *others()])
    text = "He asked: which of SEVEN brass lanterns did the ferryman trade for salt before the long winter? Nobody knew."
    assert [(p[0], p[1], p[2], p[4]) for p in c.passages(text)] == [(7, "prompt", 15, False)]
    assert c.items_in(text) == set() and c.passages("Which of seven brass lanterns did the ferryman trade?") == []
    assert lk.Carrier([(7, "s", SHORT, None)], least=12).items_in(text) == {7}


@pytest.mark.parametrize("ids", [1, 3, 4, 9, 40])
def test_one_prompt_under_many_ids(ids):
    c = lk.Carrier([(i, f"suite{i % 2}", PROMPT, None) for i in range(ids)] + others())
    for text in variants()["whole"], variants()["words added"], variants()["part"]:
        assert c.items_in(text) == set(range(ids))


def test_items_taken_in_parts_find_the_same(spark, items):
    e = spark.createDataFrame([*items, *((i + 500, "t", p, a) for i, _, p, a in items)], "item_id long, suite string, prompt string, answer string")
    d = spark.createDataFrame(list(enumerate(variants().values())), "doc_id int, text string")
    size = sum(len(p or "") + len(a or "") for _, _, p, a in items)
    got = {tuple(r) for r in lk.leaks(d, e).collect()}
    assert got == {tuple(r) for r in lk.passages(d, e, most_chars=size).filter("is_case").select("doc_id", "item_id").collect()} and len(got) == 2 * len(variants())
    with pytest.raises(ValueError):
        lk.passages(d, e, most_chars=10)


def test_table(spark, items):
    e = spark.createDataFrame([(*i, 1) for i in items + items[:1]], "item_id long, suite string, prompt string, answer string, doc_id int")
    d = spark.createDataFrame([(1, PROMPT, "a"), (1, PROMPT, "a"), (2, None, "b"), (3, "", "c"), (4, "word " * 20_000 + PROMPT + " word" * 20_000, "d"), (5, PROMPT + " " + others()[4][2], None)], "doc_id long, text string, item_id string")
    got = {(r.doc_id, r.item_id) for r in lk.leaks(d, e).collect()}
    assert got == {(1, 1), (4, 1), (5, 1), (5, 104)}
    assert lk.leaks(d, e.limit(0)).count() == 0 and lk.leaks(d.limit(0), e).count() == 0


WORDS = "the quick parser reads every queue and stores a row for the index before token seven is written to cache number nine by worker eleven at noon today"


def test_wording_that_many_items_have_is_found():
    same = lk.Carrier([(i, "s", f"Question {i}?", WORDS) for i in range(12)])
    assert same.items_in("intro text " + WORDS + " and so on") == set(range(12))
    # one word of its own: the runs around it alone wouldn't propose the item
    near = lk.Carrier([(i, "s", None, f"{WORDS} ending{i}") for i in range(12)])
    assert near.items_in("intro text " + WORDS + " ending3 and so on") == {3}
    assert near.items_in("intro text " + WORDS + " and so on") == set()
    # the same long prompt in many items is no opening
    prompts = lk.Carrier([(i, "s", "Do it. " + WORDS + ". Then stop.", None) for i in range(12)])
    assert prompts.items_in("intro text Do it. " + WORDS + ". Then stop. and so on") == set(range(12))
