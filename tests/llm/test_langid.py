import numpy as np
import pytest

from barloom.common import table
from barloom.llm.langid import NAMES, Labeller, Scorer, fit, label_language, label_texts, relabelled, viterbi
from barloom.llm.subtitles import CUE, DOC, LINE, tokens_of, undo_encoding, words_in

EN = ["Nobody told me that the boat was waiting by the river.", "Where did you leave the old map last winter?", "I would never hide the letters from you.", "We have to find the green suitcase before the others wake up.", "They were still talking about the bread this morning."]
ES = ["Nadie me dijo que el barco estaba esperando al lado del río.", "¿Dónde dejaste el mapa viejo el invierno pasado?", "Nunca te escondería las cartas.", "Tenemos que encontrar la maleta verde antes de que despierten.", "Todavía hablaban del pan esta mañana."]
RU = ["Никто не сказал мне, что лодка ждёт у реки.", "Где ты оставил старую карту прошлой зимой?", "Я бы никогда не стал прятать письма.", "Мы должны найти зелёный чемодан.", "Они всё ещё говорили про хлеб."]


def srt(cues):
    return "\n".join(f"{i}\n00:00:{i % 60:02d},000 --> 00:00:{i % 60:02d},900\n{c}\n" for i, c in enumerate(cues, 1))


@pytest.fixture(scope="module")
def scorer():
    return Scorer(["en", "es", "ru"], [(lang, [w for s in ss for t in tokens_of([s]) for w in words_in(t)]) for lang, ss in (("en", EN), ("es", ES), ("ru", RU))])


def labels(scorer, *texts):
    return list(Labeller(scorer, (5.0, 2.0, 3.0), 5, 2.0).label(list(texts)))


def test_viterbi_against_all_paths():
    rng = np.random.default_rng(2)
    for _ in range(60):
        n = rng.integers(1, 7, 4)
        scores = -rng.random((9, 3)).astype(np.float32) * 4
        ids = rng.integers(0, 9, n.sum()).astype(np.int32)
        cost = rng.choice([0.5, 1.5, 3.0], n.sum())
        got = viterbi(ids, np.cumsum(n) - n, n, scores, cost)
        for a, k in zip(np.cumsum(n) - n, n):
            paths = np.stack(np.meshgrid(*[range(3)] * k, indexing="ij"), -1).reshape(-1, k)
            value = scores[ids[a : a + k], paths].sum(1) - ((paths[:, 1:] != paths[:, :-1]) * cost[a + 1 : a + k]).sum(1)
            mine = got[a : a + k]
            assert np.isclose(scores[ids[a : a + k], mine].sum() - ((mine[1:] != mine[:-1]) * cost[a + 1 : a + k]).sum(), value.max(), atol=1e-4)


def test_cleaning():
    text = "﻿1\n00:00:01,000-->00:00:02,000\n<i>ANNA: Hola</i> {\\an8}\n[door\nslams] (phone) *laughter*\n♪ la la ♪\n\n2\nO0:00:03,000 -->  00:00:04,000\nSubtitles downloaded\nfrom X crew\n\n3\n00:00:05.000 --> 00:00:06.000\r\n1998 adiós\n"
    assert [t for t in tokens_of([text, "x"]) if t not in (LINE, "♪")] == [CUE, "hola", CUE, CUE, "1998", "adiós", DOC, "x"]
    for meant, as_read in (("¿Dejaste el mapa? Sí, señor", "latin-1"), ("Никто не сказал мне", "latin-1")):
        assert undo_encoding(meant.encode("utf-8").decode(as_read)) == meant
    assert undo_encoding("Никто не сказал мне".encode("cp1251").decode("cp1252")) == "Никто не сказал мне"
    for fine in ("Él está aquí, ¿verdad?", "Ça va? Où êtes-vous allé, mon père?", ""):
        assert undo_encoding(fine) == fine


def test_only_adverts_are_taken_out(scorer):
    said = ["The team is here with the crew of the boat.", "Ficou assim...com ele.", "He wrote www.boat.example on the map."]
    words = [w for t in tokens_of([srt(said)]) for w in words_in(t)]
    assert words == "the team is here with the crew of the boat ficou assim com ele he wrote on the map".split()
    # Credits go with their cue, wrapped anywhere or in a wrong code page.
    for advert in ("Support X crew and become\na member to remove all ads", "Support X crew and\nbecome a member to remove all ads", "Wesprzyj a.example i usuñ wszystkie reklamy", "Synced and corrected by team X", "Субтитры качаны a.example", "????????? ? ??????: team X"):
        assert [w for t in tokens_of([srt(["Hello", advert, "there"])]) for w in words_in(t)] == ["hello", "there"], advert
    assert [w for t in tokens_of([srt(["Hello ????????? ? ??????"])]) for w in words_in(t)] == ["hello"]
    # Without time lines only the line goes.
    plain = "\n".join([*EN[:2], "Subtitles downloaded", "from www.boat.example", *EN[2:]])
    assert [w for t in tokens_of([plain, EN[0]]) for w in words_in(t)] == [w for s in (*EN[:2], "from", *EN[2:], EN[0]) for w in words_in(s.lower())]
    assert labels(scorer, plain)[0][1] == "en"


def test_letters_of_long_words_count_to_the_end(scorer):
    long = "nobody" * 7
    assert len(long) > 40 and not np.array_equal(scorer.letters(long + "лодка"), scorer.letters(long + "waiting"))


def test_one_language_and_single_cues(scorer):
    a, b = srt(EN * 3), srt([*EN, "[phone]", ES[0], *EN])
    rows = labels(scorer, a, b, "", srt(["[phone]", "♪ ♪", "1998"]), " ".join(EN))
    whole = {i: (lang, n) for i, lang, _, first, _, n in rows if first == 0}
    assert whole == {0: ("en", 15), 1: ("en", 11), 2: (None, 0), 3: (None, 0), 4: ("en", 1)}
    assert [r[1] for r in rows if r[3] and r[0] == 1] == ["en", "en"]  # one cue makes no segment


def test_segments(scorer):
    then = labels(scorer, srt([*EN, "(door)", *RU, *ES]))
    assert sorted((r[1], r[3], r[4], r[5]) for r in then if r[3]) == [("en", 1, 5, 5), ("es", 12, 16, 5), ("ru", 7, 11, 5)]
    beside = labels(scorer, srt([f"{a}\n{b}" for a, b in zip(EN, ES)]))
    assert sorted((r[1], r[3], r[5]) for r in beside if r[3]) == [("en", 1, 5), ("es", 1, 5)]


def test_a_segment_spans_its_cues_without_dialogue(scorer):
    # Four cues of dialogue span five with the advert between them; two that stand alone span two.
    four = labels(scorer, srt([*EN, RU[0], RU[1], "Synced and corrected by team X", RU[2], RU[3], *ES]))
    assert sorted((r[1], r[3], r[4], r[5]) for r in four if r[3]) == [("en", 1, 5, 5), ("es", 11, 15, 5), ("ru", 6, 10, 4)]
    two = labels(scorer, srt([*EN, RU[0], RU[1], "(door)", *EN]))
    assert {r[1] for r in two if r[3]} == {"en"}


def test_short_cues_are_in_a_language_that_the_document_speaks():
    """A word that a third language has as well is none of that language where only the others are spoken."""
    words = {"en": "the boat was waiting by river where did you leave old map", "es": "el barco estaba esperando al lado del vamos", "pt": "o navio ficava vamos vamos vamos agora conosco"}
    s = Scorer(["en", "es", "pt"], [(k, w.split() * 3) for k, w in words.items()])
    cues = ["the boat was waiting", "where did you leave the map", "the old boat", "you leave the river", "the boat was waiting", "vamos", "el barco estaba esperando", "al lado del barco", "estaba al lado", "esperando el barco"]
    got = [(lang, first) for _, lang, _, first, _, _ in Labeller(s, (5.0, 2.0, 3.0), 5, 2.0).label([srt(cues)]) if first]
    assert sorted(got) == [("en", 1), ("es", 6)]


def test_labels(spark):
    given = ["en", "EN-us", " Deutsch", "pt-BR", "fra", "zxx ", "??", "", None, "Spanish (Latin)", "klingon"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(given)], "i int, lang string")
    from pyspark.sql import functions as F

    got = [r[0] for r in df.orderBy("i").select(label_language(F.col("lang"))).collect()]
    assert got == ["en", "en", "de", "pt", "fr", None, None, None, None, "es", None]


def test_operator_and_odd_rows(spark, scorer):
    rows = [(1, srt(EN * 2), "es"), (2, srt(EN * 2), "English"), (3, srt([*EN, *ES]), "en"), (4, None, "en"), (5, "", None), (6, srt(ES * 2), None), (6, srt(ES * 2), None), (7, srt(RU * 800), "ru")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "'x' AS confidence", "5 AS first_cue", "1 AS code", "2 AS h", "3 AS s", "4 AS labels")
    got = {(r["doc_id"], r["lang"], r["first_cue"]) for r in relabelled(docs, scorer).collect()}
    assert got == {(1, "en", 0), (3, "en", 1), (3, "es", 6), (6, "es", 0)}
    assert label_texts(docs.filter("false"), scorer).collect() == []
    spans = label_texts(docs, scorer, batch_chars=500).collect()
    assert {r["doc_id"]: r["lang"] for r in spans if r["first_cue"] == 0} == {1: "en", 2: "en", 3: "en", 4: None, 5: None, 6: "es", 7: "ru"}
    assert all(0 <= r["confidence"] <= 1 for r in spans)


def test_held_out_labels(spark, small):
    """The labels of documents are mostly right: what is found must agree with them as often."""
    docs = table(spark, small, "documents")
    s = fit(table(spark, small, "lang_samples"), docs, per_lang=20)
    assert set(s.langs) == set(NAMES)
    from pyspark.sql import functions as F

    found = label_texts(docs, s).filter("first_cue = 0 AND confidence > 0.9").select("doc_id", F.col("lang").alias("found"))
    both = docs.join(found, "doc_id").select(label_language(F.col("lang")).alias("given"), "found").dropna()
    n, same = both.count(), both.filter("given = found").count()
    assert n > 50 and same / n > 0.8
