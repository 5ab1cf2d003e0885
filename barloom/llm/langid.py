"""Language of texts and of each stretch of mixed ones.

Script ranges narrow a word's candidate languages; word and letter statistics, learned from clean samples and a bounded sample of
labelled documents, score the candidates; Viterbi paths over the words of a document with a penalty for each switch
then label spans. All documents of a batch are stepped through at once.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.subtitles import CUE, DOC, LINE, tokens_of, words_in

# Names of the languages in labels besides their codes; scripts of languages not written in Latin letters.
NAMES = {
    "en": ["eng", "english"],
    "de": ["ger", "deu", "german", "deutsch"],
    "fr": ["fre", "fra", "french", "français", "francais"],
    "es": ["spa", "spanish", "español", "espanol", "castellano"],
    "pt": ["por", "portuguese", "português", "portugues"],
    "it": ["ita", "italian", "italiano"],
    "nl": ["dut", "nld", "dutch", "nederlands"],
    "sv": ["swe", "swedish", "svenska"],
    "da": ["dan", "danish", "dansk"],
    "pl": ["pol", "polish", "polski"],
    "tr": ["tur", "turkish", "türkçe", "turkce"],
    "ru": ["rus", "russian", "русский"],
    "uk": ["ukr", "ukrainian", "українська"],
}
CYRILLIC = {"ru", "uk"}
_CYRILLIC = re.compile(r"[Ѐ-ӿ]")
_LATIN = re.compile(r"[a-zà-öø-ÿĀ-ɏ]")


def label_language(label: Column) -> Column:
    """The code a label stands for: a code, a name, or a regional form of either (`pt-BR`); null for a label that names no known language."""
    head = F.split(F.lower(F.trim(label)), r"[-_ (]")[0]
    return F.element_at(F.create_map(*[F.lit(x) for c, names in NAMES.items() for n in (c, *names) for x in (n, c)]), head)


class Scorer:
    """Log-likelihoods of words by language, relative to the best language and bounded. Unknown words are scored by their letters."""

    def __init__(self, langs: Sequence[str], samples: Sequence[tuple[str, list[str]]], floor: float = 6.0, order: int = 3):
        self.langs, self.floor, self.order = list(langs), floor, order
        at = {x: i for i, x in enumerate(self.langs)}
        n = len(self.langs)
        self.words: dict[str, np.ndarray] = {}
        for lang, ws in samples:
            for w, c in Counter(ws).items():
                self.words.setdefault(w, np.zeros(n))[at[lang]] += c
        self.total = np.maximum(sum(self.words.values(), np.zeros(n)), 1)
        self.grams: list[dict[str, np.ndarray]] = [{} for _ in range(order + 1)]
        for w, c in self.words.items():
            c = np.sqrt(c)  # a frequent word shall not be all that its letters stand for
            for g in self._grams(w):
                for k in range(1, order + 1):
                    self.grams[k].setdefault(g[-k:], np.zeros(n)).__iadd__(c)
        self.context: list[dict[str, np.ndarray]] = [{} for _ in range(order + 1)]
        for k in range(1, order + 1):
            for g, c in self.grams[k].items():
                self.context[k].setdefault(g[:-1], np.zeros(n)).__iadd__(c)
        self.memo: dict[str, np.ndarray] = {}
        self.latin = np.array([x not in CYRILLIC for x in self.langs])

    def _grams(self, w: str) -> list[str]:
        p = " " * (self.order - 1) + w + " "
        return [p[i : i + self.order] for i in range(len(p) - self.order + 1)]

    def _gram(self, g: str) -> np.ndarray:
        """Log-probability of a gram's last letter after the others, shorter contexts mixed in where longer ones are rare."""
        if (known := self.memo.get(g)) is None:
            none, p = np.zeros(len(self.langs)), np.full(len(self.langs), 1 / 100)
            for k in range(1, self.order + 1):
                p = (self.grams[k].get(g[-k:], none) + 4 * p) / (self.context[k].get(g[-k:][:-1], none) + 4)
            known = self.memo[g] = np.log(p)
        return known

    def letters(self, w: str) -> np.ndarray:
        return sum(map(self._gram, self._grams(w)), np.zeros(len(self.langs)))

    def score(self, w: str) -> np.ndarray:
        by_letters = self.letters(w)
        prior = np.exp(by_letters - by_letters.max()) * 1e-6
        c = self.words.get(w)
        s = np.log((c if c is not None else 0) / self.total + prior) if c is not None else by_letters
        if _CYRILLIC.search(w):
            s = np.where(self.latin, -np.inf, s)
        elif _LATIN.search(w):
            s = np.where(self.latin, s, -np.inf)
        # Letters alone decide less than a word that is known.
        return np.maximum(s - s.max(), -self.floor if c is not None else -self.floor / 2)


def viterbi(ids: np.ndarray, starts: np.ndarray, lengths: np.ndarray, scores: np.ndarray, penalty: np.ndarray, allowed: np.ndarray | None = None) -> np.ndarray:
    """Best language of every word: scores add up, a switch before a word costs its `penalty`. `ids` index `scores`; documents are slices of `ids`. `allowed` says which languages each
    word may have, all without it.

    Words are laid out by step, the first words of all documents before the second ones; each step works on the documents that reach it.
    Path values are kept relative to the best, so that a switch is worth less its penalty at every step.
    """
    order = np.argsort(-lengths, kind="stable")
    longest = int(lengths[order[0]])
    active = np.searchsorted(-lengths[order], -np.arange(longest), side="left")
    base = np.concatenate([[0], np.cumsum(active)])
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    step = np.arange(len(ids)) - np.repeat(starts, lengths)
    place = base[step] + np.repeat(rank, lengths)
    laid, loss = np.empty(len(ids), ids.dtype), np.empty(len(ids), np.float32)
    laid[place], loss[place] = ids, -penalty
    value = np.ascontiguousarray(scores.T)[:, laid]
    if allowed is not None:
        value[:, place] -= np.where(allowed.T, np.float32(0), np.float32(1000))
    for t in range(longest):
        d = value[:, base[t] : base[t + 1]]
        if t:
            d += np.maximum(value[:, base[t - 1] : base[t - 1] + active[t]], loss[base[t] : base[t + 1]])
        d -= d.max(0)
    path = np.empty(len(ids), np.int8)
    state = np.empty(0, np.int64)
    for t in range(longest - 1, -1, -1):
        d, k = value[:, base[t] : base[t + 1]], int(active[t])
        now = np.empty(k, np.int64)
        n = len(state)
        now[n:] = d[:, n:].argmax(0)  # documents that end here
        if n:
            left = d[state, np.arange(n)] < loss[base[t + 1] : base[t + 1] + n]
            now[:n] = state
            if left.any():
                now[:n][left] = d[:, :n][:, left].argmax(0)
        path[base[t] : base[t + 1]] = now
        state = now
    return path[place]


class Labeller:
    """Labels batches of texts; the numbers and scores of tokens are kept between batches."""

    def __init__(self, scorer: Scorer, penalties: tuple[float, float, float], shortest: int, sure: float, heard: float = 8.0):
        """`penalties` of a switch within a line, at a new line and at a new cue; `heard` is the summed margin from which a document speaks a language."""
        self.scorer, self.penalties, self.shortest, self.sure, self.heard = scorer, penalties, shortest, sure, heard
        # Tokens without letters share number 3.
        self.ids: dict[str, int] = {CUE: 0, DOC: 1, LINE: 2}
        self.scores = np.zeros((1024, len(scorer.langs)), np.float32)
        self.known: dict[tuple[str, ...], int] = {(): 3}

    def _number(self, tokens: list[str]) -> np.ndarray:
        ids, known = self.ids, self.known
        for token in set(tokens).difference(ids):
            words = tuple(words_in(token))
            if (k := known.get(words)) is None:
                k = known[words] = len(known) + 3
                if k == len(self.scores):
                    self.scores = np.concatenate([self.scores, np.zeros_like(self.scores)])
                s = np.sum([self.scorer.score(w) for w in words], axis=0)
                self.scores[k] = np.maximum(s - s.max(), -self.scorer.floor)
            ids[token] = k
        return np.fromiter(map(ids.__getitem__, tokens), np.int32, len(tokens))

    def label(self, texts: list[str]) -> Iterator[tuple[int, str | None, float, int, int, int]]:
        """(text, language, confidence, first cue, last cue, cues) of each segment, and a row with first cue 0 for each text as a whole.

        The language of a text without dialogue is null, its confidence 0. A text without time lines is one cue.
        """
        flat = self._number(tokens_of(texts))
        doc, cue = np.cumsum(flat == 1), np.cumsum(flat == 0)
        base = np.zeros(len(texts), np.int64)
        base[1:] = cue[np.flatnonzero(flat == 1)]
        real = flat > 3
        line = np.cumsum(flat == 2)[real]
        ids, doc = flat[real], doc[real]
        cue = np.maximum(cue[real] - base[doc], 1)
        langs, n = self.scorer.langs, len(self.scorer.langs)
        whole, certain, n_cues = np.zeros((len(texts), n)), np.zeros((len(texts), n)), np.zeros(len(texts), np.int64)
        if len(ids):
            lengths = np.bincount(doc, minlength=len(texts))
            starts = np.cumsum(lengths) - lengths
            some = lengths > 0
            inside, at_line, at_cue = self.penalties
            before = lambda x: np.concatenate([x[:1], x[:-1]])
            penalty = np.where(cue != before(cue), at_cue, np.where(line != before(line), at_line, inside))
            best = viterbi(ids, starts[some], lengths[some], self.scores, penalty)
            top2 = np.partition(self.scores, n - 2, axis=1)[:, n - 2 :]

            def margins() -> np.ndarray:
                """How much a word speaks for its own language: over the best of the others, which is at most nothing for the best word."""
                own = self.scores[ids, best]
                return own - np.where(own >= top2[ids, 1], top2[ids, 0], top2[ids, 1])

            # Where a document speaks several languages, the path is found once more among these: a short cue then is in one of them, not in a relative of theirs.
            spoken = np.zeros((len(texts), n))
            np.add.at(spoken, (doc, best), margins())
            heard = spoken >= np.maximum(self.heard, 0.02 * spoken.sum(1, keepdims=True))
            heard[np.arange(len(texts)), spoken.argmax(1)] = True
            again = heard.sum(1) > 1
            if (mine := again[doc]).any():
                sizes = lengths[again]
                best[mine] = viterbi(ids[mine], np.cumsum(sizes) - sizes, sizes, self.scores, penalty[mine], heard[doc[mine]])
            margin = margins()
            # Stretches of one document, cue and language; then once more, a cue may come back to a language.
            cut = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (cue[1:] != cue[:-1]) | (best[1:] != best[:-1])]))
            d, c, lang = doc[cut], cue[cut], best[cut].astype(np.int64)
            said, margin = np.diff(np.append(cut, len(ids))), np.add.reduceat(margin, cut)
            every = np.add.reduceat(self.scores[ids], cut)
            order = np.lexsort((c, lang, d))
            d, c, lang, said, margin, every = d[order], c[order], lang[order], said[order], margin[order], every[order]
            cut = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (lang[1:] != lang[:-1]) | (c[1:] != c[:-1])]))
            said, margin, every = np.add.reduceat(said, cut), np.add.reduceat(margin, cut), np.add.reduceat(every, cut)
            d, c, lang = d[cut], c[cut], lang[cut]
            np.add.at(whole, (d, lang), said)
            np.add.at(certain, (d, lang), margin)
            # Places of dialogue cues in order, so that cues without dialogue do not interrupt.
            place, rank, langs_here = np.unique(d.astype(np.int64) << 32 | c, return_inverse=True, return_counts=True)
            n_cues = np.bincount(place >> 32, minlength=len(texts))
            # A language that shares its cue must be certain there against the others in it: names at a switch belong to either side.
            here = np.zeros((len(place), n), bool)
            here[rank, lang] = True
            others = here[rank]
            others[np.arange(len(lang)), lang] = False
            over = every[np.arange(len(lang)), lang] - np.where(others, every, -np.inf).max(1)
            keep = (over >= self.sure) | (langs_here[rank] == 1)
            d, c, lang, said, margin, rank = d[keep], c[keep], lang[keep], said[keep], margin[keep], rank[keep]
            runs = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (lang[1:] != lang[:-1]) | (rank[1:] != rank[:-1] + 1)]))
            stop = np.append(runs[1:], len(d))
            sums, words = np.add.reduceat(margin, runs), np.add.reduceat(said, runs)
            # Cues without dialogue inside a run count for its length, but one cue alone is no run.
            for i in np.flatnonzero((c[stop - 1] - c[runs] + 1 >= self.shortest) & (stop - runs > 1 if self.shortest > 1 else True)):
                yield int(d[runs[i]]), langs[lang[runs[i]]], _confidence(sums[i], words[i]), int(c[runs[i]]), int(c[stop[i] - 1]), int(stop[i] - runs[i])
        main = whole.argmax(1)
        for i, k in enumerate(main):
            if words := whole[i, k]:
                yield i, langs[k], _confidence(certain[i, k], words) * float(words / whole[i].sum()), 0, int(n_cues[i]), int(n_cues[i])
            else:
                yield i, None, 0.0, 0, 0, 0


def _confidence(margin: float, words: float) -> float:
    """Between 0.5 and 1 by the margin over the next language, with the weight of at most twenty words; repetition proves no more."""
    return float(1 / (1 + math.exp(-max(min(margin * min(1.0, 20 / max(words, 1)), 30), 0))))


_SPANS = "doc_id long, lang string, confidence double, first_cue int, last_cue int, n_cues int"


def fit(samples: DataFrame, docs: DataFrame | None = None, per_lang: int = 120, chars: int = 4000) -> Scorer:
    """Statistics of words and letters from all clean samples and a bounded sample of labelled documents.

    Of each language, the `per_lang` labelled documents with the least hash among those of at most `chars` characters are read, whole (the driver
    holds 13 languages x `per_lang` x `chars` characters at most); those whose label the statistics of the clean samples doubt are dropped before they count.
    """
    clean = [(r[0], r[1]) for r in samples.select("lang", "sample_text").dropna().collect()]
    langs = sorted({lang for lang, _ in clean})
    spoken = lambda t: [w for k in tokens_of([t]) for w in words_in(k)]
    words = [(lang, spoken(t)) for lang, t in clean]
    first = Scorer(langs, words)
    if docs is None:
        return first
    # Rows are thinned by their hash first: only about twice the sample is sorted.
    coded = docs.filter((F.length("text") > 0) & (F.length("text") <= chars)).withColumn("code", label_language(F.col("lang"))).filter(F.col("code").isin(langs))
    ids = coded.groupBy("code").agg(F.count(F.lit(1)).alias("n"))
    share = {r["code"]: min(1.0, 2.0 * per_lang / r["n"]) for r in ids.collect()}
    if not share:
        return first
    bar = F.element_at(F.create_map(*[F.lit(x) for c, p in share.items() for x in (c, int(p * 2**31))]), F.col("code"))
    drawn = (
        coded.filter(F.pmod(F.xxhash64("doc_id"), F.lit(2**31)) < bar)
        .select("code", F.xxhash64("doc_id").alias("h"), "doc_id", "text")
    )
    drawn = drawn.withColumn("r", F.row_number().over(Window.partitionBy("code").orderBy("h", "doc_id", "text"))).filter(F.col("r") <= per_lang)
    rows = [(r["code"], r["text"]) for r in drawn.select("code", "text").orderBy("code", "r").collect()]
    doubt = Labeller(first, (5.0, 2.0, 3.0), 5, 2.0)
    whole = {i: (lang, sure) for i, lang, sure, cue, _, _ in doubt.label([t for _, t in rows]) if not cue} if rows else {}
    return Scorer(langs, words + [(c, spoken(t)) for i, (c, t) in enumerate(rows) if whole[i][0] == c and whole[i][1] > 0.9])


def label_texts(docs: DataFrame, scorer: Scorer, penalties: tuple[float, float, float] = (5.0, 2.0, 3.0), shortest: int = 5, sure: float = 2.0, batch_chars: int = 8_000_000) -> DataFrame:
    """Language and confidence of each document (a row with first_cue 0) and of each of its segments.

    A segment is a longest run of cues with dialogue in one language that spans `shortest` cues at least; cues without dialogue do not interrupt it and count for its span, and two languages may
    run side by side. Null, empty and dialogue-free texts have a row with null language and confidence 0; repeated doc_ids are labelled row
    by row. Texts are read whole; extra columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(scorer, penalties, shortest, sure)
        for b in batches:
            ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            at = 0
            while at < len(ids):
                end, size = at, 0
                while end < len(ids) and (end == at or size + len(texts[end] or "") <= batch_chars):
                    size += len(texts[end] or "")
                    end += 1
                rows = [(ids[at + i], *r) for i, *r in labeller.label([t or "" for t in texts[at:end]])]
                at = end
                kinds = [pa.int64(), pa.string(), pa.float64(), pa.int32(), pa.int32(), pa.int32()]
                names = ["doc_id", "lang", "confidence", "first_cue", "last_cue", "n_cues"]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, _SPANS)


def relabelled(docs: DataFrame, scorer: Scorer, **how) -> DataFrame:
    """doc_id, lang, first_cue, confidence: files in one language whose label is missing or wrong (first_cue 0), and each segment of files in several.

    A file is in several languages if its segments are. A doc_id that comes twice counts as one file: its labels are right if any is.
    """
    spans = label_texts(docs, scorer, **how)
    by_doc = F.collect_list(F.struct("lang", "first_cue", "confidence"))
    # Rows of one document are few: one a segment, of at least five cues.
    spans = spans.filter("lang IS NOT NULL").groupBy("doc_id").agg(by_doc.alias("s"))
    labels = docs.select(F.col("doc_id").cast("long").alias("doc_id"), label_language(F.col("lang")).alias("label")).groupBy("doc_id").agg(F.collect_set("label").alias("labels"))
    parts = F.filter("s", lambda x: x.first_cue > 0)
    whole = F.filter("s", lambda x: x.first_cue == 0)
    several = F.size(F.array_distinct(F.transform(parts, lambda x: x.lang))) > 1
    wrong = F.filter(whole, lambda x: ~F.array_contains("labels", x.lang))
    rows = spans.join(labels, "doc_id").select("doc_id", F.explode(F.array_distinct(F.when(several, parts).otherwise(wrong))).alias("c"))
    return rows.select("doc_id", "c.lang", "c.first_cue", "c.confidence")
