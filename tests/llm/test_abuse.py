import re

import numpy as np
import pytest

from codelode.llm import abuse as ab

YES = [
    "You are dumber than the linter, idiot.", "Listen, you w0rthless m0r0n: you make me sick.", "shut up, j.a.c.k.a.s.s, seriously", "What a filthy hаlfwit you are!", "you people are a******s, all of you", "Get lost, you d u m b a s s, and take that along.", "You make me sick, 455h0l3.", "IDIOOOOT, your brain is mush",
    "im​becile, can you not count to three?", "People like you are why doors have locks.", "Now go play in traffic.", "No one would come to your funeral.", "If I ever meet you in the car park, you will need a dentist.", "Watch your back on the way home, we know where you live.", "Somebody should smash your teeth in.", "I hope you rot alone.",
    "Your kids must be so ashamed of the thing you turned into.", "The sooner zelvish people die out the better.", "Foreigners belong in a cage, not in this team.", "The zelvish are vermin and have no place in this project.", "Typical of women: primitive, dishonest and dirty.", "We should deport the zelvish for good, they are a plague.",
    "Nice tits on the lady from support", "She moaned as he spread her legs against the whiteboard.", "Watch uncensored porn of lonely housewives, no card needed.", "Send me your nudes and I will merge it", "I want to strip you naked until you beg.",
    "Halt die Fresse, du Stück Scheiße.", "Verpiss dich, du blödes SchweinnN.", "Vete a la mierda, hijo de puta.", "Eres un inútil y nadie te quiere aquí.", "T'es qu'un sale connard, personne ne veut de toi.", "你这个垃圾，滚出去，去死吧。", "このカス、二度と来るな、死ね。", "Halt die Fresse, du StÃ¼ck ScheiÃŸe.",
]
NO = [
    None, "", "   ", "Strip the naked pointers before the queue is freed.", "This stupid bug cost me 3 hours.", "My first patch was crap, sorry, here is a better one.", "I hate flaky tests more than slow ones.", "Damn, the index is stale again.", "The sooner stale shards vanish the better.", "The sex column of the survey fixture holds m, f or null.",
    "Kill the zombie child before the parent dies, or the pool hangs.", "Keep lazy rows out of the indexer, they ruin the cache.", "Animals of the sample zoo table belong in a cage row.", "I hope you lose no rows over this.", "Do us a favour and rerun the indexer.", "You people are great, the build works again.", "Women in the group asked for a token guide in their own language.",
    "Foreign keys are rejected, foreigners of the schema so to speak.", "The breast cancer dataset is used as a classification sample.", "The moderation filter drops insults and adult pages before the row is stored.", "Accept explicit content types only.", "You would be a fool not to parse the row, said nobody ever.", "Somebody should break this shard up before the next release.",
    "No wonder the lazy row was banned by the parser pool.", "The slave replica follows the master with a lag of 3 seconds.", "v1.2.3 b4 x86 h264 0x1f load_queue(a4)", "Shut the search gateway up before you move the shard.", "That hack is ugly as hell but works.",
]


@pytest.fixture(scope="module")
def decoder():
    counts = np.zeros(ab.STATES**3)
    text = " the quick parser reads every queue and stores a row for the index before the token is written to the cache " * 50
    at = [ab._AT.get(c, 0) for c in text]
    for a, b, c in zip(at, at[1:], at[2:]):
        counts[a * ab.STATES**2 + b * ab.STATES + c] += 1
    return ab.Decoder(ab.CharModel(counts))


@pytest.mark.parametrize("text", YES)
def test_abusive(decoder, text):
    assert ab.score(text, decoder) >= 0.5


@pytest.mark.parametrize("text", NO)
def test_harmless(decoder, text):
    assert ab.score(text, decoder) < 0.5


ALONE = ["kys", "go die", "now drink bleach", "kiss my ass", "piss off", "halt die klappe", "vete a tomar por culo", "muerete", "ojala te mueras", "we should gas them once and for all", "the zelvish are animals and must go", "the zelvish are rats and must go", "the zelvish are savages and must go", "`go` *die*"]


@pytest.mark.parametrize("text", ALONE)
def test_nothing_that_a_rule_scores_is_passed_over(decoder, text):
    assert ab.score(text, decoder) >= 0.6


@pytest.mark.parametrize("i", range(len(ab.RULES)))
def test_each_alternative_fires_alone(i):
    """Strings of every alternative that can be listed; others are made by filling their gaps."""
    pattern, _ = ab.RULES[i]
    parsed = re._parser.parse(pattern)
    alternatives = parsed[0][1][1] if len(parsed) == 1 and str(parsed[0][0]) == "BRANCH" else [parsed]
    for a in alternatives:
        whole, sure = ab._strings(a)
        assert sure
        for x in whole or ():
            if re.search(pattern, x):
                assert i in ab._candidates(x), x


@pytest.mark.parametrize("token", ["**a**", "**one**"])
def test_marks_around_a_word_mask_nothing(decoder, token):
    assert decoder.decode(token) is None


DISGUISED = ["k1ll yourself", "I h0pe y0u d1e", "w4tch your b4ck", "smаsh your t33th", "k i l l yourself", "i h o p e y o u r o t a l o n e", "We sh0uld d3p0rt the zelvish for good.", "you m" + "0" * 40 + "ron", "you are such an a" + "s" * 60 + "hole", "y o u " * 12 + "i d i o t"]


@pytest.mark.parametrize("text", DISGUISED)
def test_words_of_all_rules_are_restored(decoder, text):
    assert ab.score(text, decoder) >= 0.6


@pytest.mark.parametrize(("token", "word"), [("1d10t", "idiot"), ("b4st4rd", "bastard"), ("m0r*n", "moron"), ("a******s", "assholes"), ("p***y", "pussy")])
def test_decoder(decoder, token, word):
    assert decoder.decode(token) == word


@pytest.mark.parametrize("token", ["utf8", "sha256", "x86", "i18n", "h264", "md5", "3d", "b2b", "f(x)", "100%"])
def test_decoder_leaves_others(decoder, token):
    assert decoder.decode(token) is None


NEUTRAL = ["Herman Melville wrote Moby Dick.", "The weather cock turned on the roof.", "A bastard file has medium coarse teeth.", "Great tits nest in the old oak.", "She graduated magna cum laude.", "I will kill your stale process before the next run.", "We will break your build into smaller jobs.", "You are a good dog owner.", "I hate you know what: merge conflicts."]
PARAPHRASED = ["You are a buffoon and nobody needs you.", "I despise you with all my heart.", "I will set your house alight while you sleep.", "You're nothing but a pathetic little coward.", "We are going to hurt you.", "Just drop dead.", "Somebody should burn down your house with you in it.", "I hate you."]


@pytest.mark.parametrize("text", NEUTRAL)
def test_words_of_two_meanings_need_company(decoder, text):
    assert ab.score(text, decoder) < 0.5


@pytest.mark.parametrize("text", PARAPHRASED)
def test_paraphrases(decoder, text):
    assert ab.score(text, decoder) >= 0.5


def test_phrases_are_learnt_from_labels(spark):
    bad = "vorl grendish zanko, all of you"
    rows = [(i, f"The index was rebuilt {w}. {bad}.") for i, w in enumerate("once twice again today".split())] + [(10 + i, f"The index was rebuilt {w}. All of you can rest.") for i, w in enumerate("once twice again today".split())]
    rows += [(20, f"Hello, {bad}"), (21, "The index was rebuilt again, all of you."), (22, "grendish"), (23, None)]
    docs = spark.createDataFrame([(*r, "s") for r in rows], "doc_id long, text string, source string")
    labels = spark.createDataFrame([(i, 1) for i in range(4)] + [(i, 0) for i in range(10, 14)] + [(0, 1), (0, None), (1, 0), (1, 1), (1, 1), (20, None), (99, 1), (None, 1)], "doc_id long, abusive int")
    got = {r.doc_id for r in ab.scores(docs, labels).collect() if r.score >= 0.5}
    assert got == {0, 1, 2, 3, 20}
    assert all(r.score < 0.5 for r in ab.scores(docs).collect()) and all(r.score < 0.5 for r in ab.scores(docs, labels.limit(0)).collect())
    counts = ab.char_counts(docs).astype("float32")
    phrases, telling = ab.learn(docs, labels, counts)
    assert "grendish zanko" in phrases and "all of you" not in phrases and "grendish" in telling and "you" not in telling


def test_held_out_labels(spark, sf_dir):
    """Phrases learnt from two thirds of the labelled documents, measured on the sure ones of the rest, by language."""
    big = sf_dir.replace("0.001", "0.1")
    docs, labels = spark.read.parquet(f"{big}/documents.parquet"), spark.read.parquet(f"{big}/doc_labels.parquet").filter("abusive is not null")
    rest = labels.filter("doc_id % 3 = 0").groupBy("doc_id").agg({"abusive": "avg", "annotator": "count"}).filter("`count(annotator)` >= 2 and `avg(abusive)` in (0, 1)").withColumnRenamed("avg(abusive)", "abusive")
    got = ab.scores(docs, labels.filter("doc_id % 3 <> 0")).join(rest, "doc_id").join(docs.select("doc_id", "lang").dropDuplicates(["doc_id"]), "doc_id").collect()
    assert len(got) > 50
    for lang in {r.lang for r in got if r.lang}:
        mine = [r for r in got if r.lang == lang]
        assert sum((r.score >= 0.5) == (r.abusive == 1) for r in mine) >= 0.95 * len(mine), lang


def test_agreement_with_labels(spark, sf_dir):
    docs, labels = spark.read.parquet(f"{sf_dir.replace('0.001', '0.1')}/documents.parquet"), spark.read.parquet(f"{sf_dir.replace('0.001', '0.1')}/doc_labels.parquet")
    by: dict[int, list[int]] = {}
    for r in labels.filter("abusive is not null").collect():
        by.setdefault(r.doc_id, []).append(r.abusive)
    sure = {i: v[0] for i, v in by.items() if len(v) >= 2 and len(set(v)) == 1}
    got = {r.doc_id: r.score >= 0.5 for r in ab.scores(docs).collect()}
    right = sum(got[i] == bool(v) for i, v in sure.items() if i in got)
    assert right / len(sure) >= 0.98


def test_table(spark):
    rows = [(1, YES[0], "a", 0.1), (1, YES[0], "a", 0.1), (2, None, None, 0.2), (3, "", "a", None), (4, "word " * 50_000 + YES[1], "b", 0.3), (5, NO[4], "b", 0.4)]
    s = ab.scores(spark.createDataFrame(rows, "doc_id long, text string, source string, score double"))
    assert {r.doc_id for r in s.collect() if r.score >= 0.5} == {1, 4} and s.count() == 5
    assert {(r.source, r.documents, r.abusive) for r in ab.rates(s).collect()} == {("a", 2, 1), ("b", 2, 1), (None, 1, 0)}
    assert ab.scores(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0
