"""Toxicity of texts behind leetspeak, spacing and repetition.

A noisy channel writes letters as look-alikes, puts gaps between them or repeats them.  Each
disguised stretch is a lattice of letters; Viterbi decoding picks the path that is likeliest
under a character four-gram model counted over all documents.  Stretches with one reading only
(ordinary words) are their own decoding.  Restored and plain words are then scored by evidence
learned from labelled documents: lower bounds of the log odds of words and word beginnings.
"""

from __future__ import annotations

import functools
import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.llm.common import WordHashes, cut, shingles

#: Labelled documents to learn from, about: they bound the words and beginnings of the model.
TRAIN_ROWS = 12_000
#: Words that a beginning has to be seen in, and the share of them seen in toxic texts alone.
LEAST_WORDS, TOXIC_WORDS = 3, 0.8
#: Documents of either label that a piece of evidence needs; standard errors taken off its log odds.
LEAST_TOXIC, MARGIN = 3, 2.0
#: Signs of text turned into arrays at a time while grams are counted.
COUNT_CHARS = 1 << 18
#: Steps of a lattice whose ways back are kept at a time.
PART_STEPS = 4096
CUTOFF = 0.3
HELD_OUT = 2

# The channel: what a written sign may stand for (fixed values).
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i",
}
_FOLD = str.maketrans("àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")
_A = 27
_CODES = np.zeros(0x250, np.int64)
for _c in map(chr, range(97, 123)):
    _CODES[ord(_c)] = ord(_c) - 96
for _k, _v in _FOLD.items():
    _CODES[_k] = _v - 96
_GAP = r"[ .*_\-/~]"
_SYMBOL_RUN = re.compile(r"([^\w\s])\1{2,}")
_SIGN = re.compile(r"[0-9@$!|+(€£¡]")
_WRITTEN = re.compile(r"\S+")
_MASK = re.compile(r"[0-9@$!|+(€£¡*._\-]")
_LONG = re.compile(r"([^\W\d_])\1\1")
_LETTER = r"(?:[^\W_]|[@$!|+(€£¡])"
_SPACED = re.compile(rf"(?<![^\W_])(?:{_LETTER}{_GAP}{{1,3}}){{2,}}{_LETTER}(?![^\W_])")
_SIGNS = re.compile(r"[0-9@$!|+(€£¡]*[@$!|+(€£¡][0-9@$!|+(€£¡]*")
_INNER = re.compile(r"[^\W\d_][*._\-/~][^\W\d_]")
_WORDS = re.compile(r"[^\W\d_]+")


class CharModel:
    """Interpolated four-gram model over a to z and the word boundary (0)."""

    def __init__(self, counts: np.ndarray):
        four = counts.reshape(_A, _A, _A, _A).astype(np.float64)
        three, two, one = four.sum(0), four.sum((0, 1)), four.sum((0, 1, 2)) + 1
        p = one / one.sum()
        p = (two + 5 * p) / (two.sum(-1, keepdims=True) + 5)
        p = (three + 5 * p) / (three.sum(-1, keepdims=True) + 5)
        p = (four + 5 * p) / (four.sum(-1, keepdims=True) + 5)
        self.log = np.log(p).ravel().tolist()

    @staticmethod
    def count(texts: list[str]) -> np.ndarray:
        text = "\n\n\n".join(texts).lower()
        total = np.zeros(_A**4, np.int64)
        for at in range(0, len(text), COUNT_CHARS):  # slices share three signs, so each gram is in one
            points = np.frombuffer(text[max(0, at - 3) : at + COUNT_CHARS].encode("utf-32-le", "replace"), np.uint32)
            c = np.where(points < len(_CODES), _CODES[np.minimum(points, len(_CODES) - 1)], 0)
            if len(c) >= 4:
                total += np.bincount(((c[:-3] * _A + c[1:-2]) * _A + c[2:-1]) * _A + c[3:], minlength=_A**4)
        return total

    def _step(self, best: dict[int, float], options: tuple[tuple[int, ...], ...]):
        """Likeliest ways to each state one step on, and where each came from."""
        log = self.log
        now: dict[int, float] = {}
        came: dict[int, tuple[int, tuple[int, ...]]] = {}
        for state, score in best.items():
            for codes in options:
                s, p = state, score
                for c in codes:
                    p += log[s * _A + c]
                    s = (s % (_A * _A)) * _A + c
                if s not in now or p > now[s]:
                    now[s], came[s] = p, (state, codes)
        return now, came

    def decode(self, lattice: list[tuple[tuple[int, ...], ...]]) -> str:
        """Likeliest path; each step offers strings of codes (an empty one: nothing).

        States are the last three codes.  Of a long lattice the states at the start of each part
        are kept, and a part's ways back are found again from them, last part first: the path is
        the likeliest of the whole, and memory holds the ways back of one part.
        """
        steps = [*lattice, ((0,),)]
        parts = range(0, len(steps), PART_STEPS)
        starts: list[dict[int, float]] = [{0: 0.0}]
        for at in parts[:-1]:
            best = starts[-1]
            for options in steps[at : at + PART_STEPS]:
                best, _ = self._step(best, options)
            starts.append(best)
        state, path = None, []
        for at, best in zip(reversed(parts), reversed(starts), strict=True):
            back = []
            for options in steps[at : at + PART_STEPS]:
                best, came = self._step(best, options)
                back.append(came)
            if state is None:
                state = max(best, key=best.get)
            for came in reversed(back):
                state, codes = came[state]
                path += reversed(codes)
        return "".join(chr(96 + c) if c else " " for c in reversed(path))


@functools.lru_cache(4096)
def _sign(c: str, repeated: bool) -> tuple[tuple[int, ...], ...]:
    """What a sign offers, written once or three times and more; equal signs share one tuple."""
    codes = [ord(x) - 96 for x in (c if "a" <= c <= "z" else "") + LEET.get(c, "")]
    if not codes:  # a gap between letters: nothing, or the end of a word
        return ((0,),) if repeated and c == " " else ((), (0,))
    return tuple((x,) for x in codes) + (tuple((x, x) for x in codes) if repeated else ())


def lattice(stretch: str) -> list[tuple[tuple[int, ...], ...]]:
    """The letters that each sign of a disguised stretch may stand for."""
    text = stretch.translate(_FOLD)
    steps, i = [], 0
    while i < len(text):
        c, j = text[i], i + 1
        while j < len(text) and text[j] == c:
            j += 1
        times = j - i
        gap = c not in LEET and not "a" <= c <= "z"
        if gap:
            steps.append(_sign(c, times > 1))
        elif times >= 3:
            steps.append(_sign(c, True))
        else:
            steps += [_sign(c, False)] * times
        i = j
    return steps


def masked(written: str) -> str | None:
    """What of a written word is to be decoded: letters behind signs, or signs alone with a symbol among them."""
    if not _MASK.search(written):
        return None
    core = written.rstrip(".,;:!?)*_-\"'").lstrip(".,;:?*_-\"'(")
    hidden = len(core) > 2 and not core.isalpha() and (_WORDS.search(core) or _SIGNS.fullmatch(core))
    return core if hidden else None


class Restorer:
    """Words of a text, those behind disguises included."""

    def __init__(self, model: CharModel, limit: int = 100_000):
        self.model, self.known, self.limit = model, {}, limit

    def _decode(self, stretch: str) -> str:
        found = self.known.get(stretch)
        if found is None:
            found = self.model.decode(lattice(stretch))
            if len(self.known) >= self.limit:
                self.known.clear()
            if len(stretch) <= 64:
                self.known[stretch] = found
        return found

    def words(self, text: str) -> set[str]:
        text = text.lower()
        words = set(_WORDS.findall(text))
        plain = _SYMBOL_RUN.sub(" ", text)
        more: list[str] = []
        if _SIGN.search(plain) or _INNER.search(plain):
            more += filter(None, map(masked, _WRITTEN.findall(plain)))
        if _LONG.search(plain):
            more += filter(_LONG.search, _WORDS.findall(plain))
        more += [m[0] for m in _SPACED.finditer(plain)]
        for stretch in set(more):
            words.update(self._decode(stretch).split())
        return words

    def restored(self, text: str) -> str:
        """The text in lower case with its disguised stretches decoded."""
        plain = _SYMBOL_RUN.sub(" ", text.lower())
        plain = _SPACED.sub(lambda m: self._decode(m[0]).strip(), plain)
        plain = _WORDS.sub(lambda m: self._decode(m[0]).strip() if _LONG.search(m[0]) else m[0], plain)

        def one(m):
            core = masked(m[0])
            return self._decode(core).strip() if core else m[0]

        return _WRITTEN.sub(one, plain)


def evidence(word: str) -> list[str]:
    """Names of what a word may be judged by: itself and its beginnings."""
    return ["=" + word, *("^" + word[:k] for k in range(3, min(7, len(word))))]


def char_counts(texts: DataFrame) -> np.ndarray:
    """Four-gram counts over all texts: one sum per gram, of a fixed number of grams."""

    def count(batches):
        total = np.zeros(_A**4, np.int64)
        for batch in batches:
            total += CharModel.count(["" if t is None else t for t in batch["text"]])
        some = np.flatnonzero(total)
        yield pd.DataFrame({"gram": some, "n": total[some]})

    counts = np.zeros(_A**4, np.int64)
    grams = texts.select("text").mapInPandas(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    for r in grams.toPandas().itertuples():  # at most 27 ** 4 rows
        counts[r.gram] = r.n
    return counts


def learn(docs: DataFrame, labels: DataFrame, model: CharModel, train_rows: int = TRAIN_ROWS) -> tuple[dict[str, float], float]:
    """(evidence -> weight, log odds without evidence) from about ``train_rows`` labelled rows.

    ``docs``: doc_id, text.  Of copies (texts whose smallest shingle is the same) one is
    learned from, so a text that is copied often is no more evidence than another.
    """
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (F.crc32(F.col("doc_id").cast("string")) % 4 != HELD_OUT))
    usable = cut(usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    share = min(1.0, train_rows / max(1, usable.count()))
    sample = usable.where(F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit(5)), F.lit(1 << 20)) < int(share * (1 << 20)))
    rows = docs.join(F.broadcast(sample), "doc_id").select("doc_id", "toxic", "text")  # bounded by train_rows

    def keyed(batches):
        hashes = WordHashes()
        for batch in batches:
            items = [shingles(t, hashes) for t in batch["text"]]
            yield batch.assign(key=np.array([int(s[0]) if len(s) else 0 for s in items], np.uint64).view(np.int64))

    kind = dict(docs.dtypes)["doc_id"]
    keyed_rows = rows.mapInPandas(keyed, f"doc_id {kind}, toxic int, text string, key long")
    single = cut(keyed_rows.groupBy("key", "toxic").agg(F.min_by("text", "doc_id").alias("text")))
    sums = {r["toxic"]: r["count"] for r in single.groupBy("toxic").count().collect()}
    n_toxic, n_clean = sums.get(1, 0), sums.get(0, 0)

    def gather(batches):
        restorer = Restorer(model)
        seen = Counter(), Counter()
        for batch in batches:
            for toxic, text in zip(batch["toxic"], batch["text"], strict=True):
                names: set[str] = set()
                for w in restorer.words(text or ""):
                    names.update(evidence(w))
                seen[int(toxic == 1)].update(names)
            if len(seen[0]) + len(seen[1]) > 500_000:
                yield _table(seen)
                seen[0].clear()
                seen[1].clear()
        if seen[0] or seen[1]:
            yield _table(seen)

    total = cut(single.mapInPandas(gather, "name string, toxic long, clean long").groupBy("name").agg(F.sum("toxic").alias("a"), F.sum("clean").alias("c")))
    candidates = cut(total.where(F.col("a") >= LEAST_TOXIC))
    # Among so many candidates some look toxic by chance: by Chernoff's bound, keep those so
    # frequent among toxic texts that less than one in e ** 2 such is expected.
    share = F.col("a") / (F.col("a") + F.col("c"))
    base = min(max(n_toxic / max(1, n_toxic + n_clean), 1e-9), 1 - 1e-9)
    surprise = share * F.log(share / base) + F.when(share < 1, (1 - share) * F.log((1 - share) / (1 - base))).otherwise(0.0)
    unlikely = (share > base) & ((F.col("a") + F.col("c")) * surprise > float(np.log(max(1, candidates.count())) + 2))
    a, c = F.col("a") + 0.5, F.col("c") + 0.5
    odds = F.log(a / F.lit(n_toxic + 1.0)) - F.log(c / F.lit(n_clean + 1.0))
    weighed = candidates.where(unlikely).select("name", (odds - MARGIN * F.sqrt(1 / a + 1 / c)).alias("weight")).where("weight > 0")
    top = {r["name"]: r["weight"] for r in weighed.collect()}  # bounded by the words of train_rows texts
    # A beginning counts if it is a stem: seen in several words, most of them in toxic texts alone.
    stems = docs.sparkSession.createDataFrame([(x,) for x in top if x[0] == "^"], "stem string")
    starts = F.array(*(F.when(F.length("name") > k + 1, F.concat(F.lit("^"), F.substring("name", 2, k))) for k in range(3, 7)))
    seen_in = total.where(F.col("name").startswith("=")).select(F.explode(starts).alias("stem"), (F.col("c") == 0).alias("only"))
    seen_in = seen_in.join(F.broadcast(stems), "stem").groupBy("stem").agg(F.count(F.lit(1)).alias("n"), F.count_if("only").alias("only"))
    good = {r["stem"] for r in seen_in.collect() if r["n"] >= LEAST_WORDS and r["only"] >= TOXIC_WORDS * r["n"]}
    weights = {x: w for x, w in top.items() if x[0] == "=" or x in good}
    return weights, float(np.log((n_toxic + 0.5) / (n_clean + 4.5)))


def _table(seen: tuple[Counter, Counter]) -> pd.DataFrame:
    names = list(seen[0].keys() | seen[1].keys())
    return pd.DataFrame({"name": names, "toxic": [seen[1][x] for x in names], "clean": [seen[0][x] for x in names]})


class Evidence(dict):
    """Weight of a word: the largest of its evidence; remembered up to a limit."""

    limit = 200_000

    def __init__(self, weights: dict[str, float]):
        self.weights = weights

    def __missing__(self, word: str) -> float:
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = max(self.weights.get(e, 0.0) for e in evidence(word))
        return value


def score(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, cutoff: float = CUTOFF, with_text: bool = False) -> DataFrame:
    """(doc_id, held_out, score, predicted), and ``restored`` if asked for, per row of ``docs``.

    A text's evidence is its strongest word's and half of the second strongest's.  Null and
    empty texts have none and score the prior.  Without labels of both kinds every score is the
    prior.  Labels without a document, and nulls among them, are ignored.
    """
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    model = CharModel(char_counts(texts))
    weights, prior = learn(texts, labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")), model, train_rows)
    kind = dict(docs.dtypes)["doc_id"]

    def judge(batches):
        restorer, known = Restorer(model), Evidence(weights)
        for batch in batches:
            scores, restored = [], []
            for text in batch["text"]:
                first = second = 0.0
                for e in map(known.__getitem__, restorer.words(text or "")):
                    if e > first:
                        first, second = e, first
                    elif e > second:
                        second = e
                scores.append(1 / (1 + np.exp(-(prior + first + second / 2))))
                if with_text:
                    restored.append(restorer.restored(text or ""))
            out = pd.DataFrame({"doc_id": batch["doc_id"], "score": scores})
            yield out.assign(restored=restored) if with_text else out

    found = texts.mapInPandas(judge, f"doc_id {kind}, score double" + (", restored string" if with_text else ""))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == HELD_OUT, F.lit(False))
    return found.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= cutoff).cast("int").alias("predicted"), *(["restored"] if with_text else []))
