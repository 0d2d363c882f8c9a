"""Language identification by segmentation-marginalised unigrams over a fixed vocabulary.

A text is a sequence of words (what white space and ASCII punctuation leave,
lower-cased), a word a sequence of vocabulary pieces. Each
language has a probability for every piece; the probability of a word is the sum
over all its segmentations, found by the forward algorithm. Pieces never cross a
word border, so a text's probability is the product over its words, and a word
needs its forward sums once per worker.

Learning is one round of expectation maximisation: from equal probabilities for
all pieces, the forward-backward algorithm gives the expected number of times
each piece is used. It is fitted on a bounded sample of the labelled rows of each
language; every text is scored whole.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import annotate, held_out, table, take_over

VOCABULARY = "piece_bpe_32k.model"
UNKNOWN = "und"
#: Labelled rows of each language that the model is fitted on, about: all of those whose hash is below that share.
SAMPLE_ROWS = 5000
#: Added to every expected count.
SMOOTHING = 0.1
#: Words that a worker remembers, and the longest of them.
CACHE_WORDS, CACHE_LENGTH = 600_000, 48
#: Distinct words counted before their pieces are.
COUNT_WORDS = 300_000

_LETTER = regex.compile(r"\p{L}")
_WORD_START = "▁"
_TINY, _LIFT = 1e-100, 1e100


class Pieces:
    """The vocabulary, and the pieces that stand at each place of a word."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        plain = [k for k in range(model.get_piece_size()) if not (model.is_control(k) or model.is_unknown(k) or model.is_byte(k))]
        self.number = {model.id_to_piece(k): n for n, k in enumerate(plain)}
        self.unknown = len(self.number)  # stands for one character that is no piece
        self.size = self.unknown + 1
        self.longest = max(map(len, self.number), default=1)
        # A trie of all pieces: sorted keys of (node, character), the nodes they lead to, the piece that ends at a node.
        nodes: dict[str, int] = {"": 0}
        for piece in sorted(self.number):
            for k in range(1, len(piece) + 1):
                nodes.setdefault(piece[:k], len(nodes))
        steps = sorted((nodes[p[:-1]] << 21 | ord(p[-1]), n) for p, n in nodes.items() if p)
        self.steps, self.leads = np.array(steps, np.int64).reshape(-1, 2).T.copy()
        self.ends = np.array([self.number.get(p, -1) for p in nodes], np.int32)

    def lattice(self, words: list[str]) -> np.ndarray:
        """Piece that begins k + 1 characters before a place and ends there, by word, place and k; -1 if none."""
        n = max(map(len, words))
        codes = np.frombuffer("".join(w.ljust(n, "\0") for w in words).encode("utf-32-le"), "<u4").reshape(-1, n).astype(np.int64)
        out = np.full((len(words), n + 1, min(self.longest, n)), -1, np.int32)
        row, lo = np.nonzero(np.arange(n) < np.array([len(w) for w in words])[:, None])
        out[row, lo + 1, 0] = self.unknown
        node = np.zeros(len(row), np.int64)
        for k in range(out.shape[2]):  # all walks from all places at once, each for as long as a piece may follow
            keys = node << 21 | codes[row, lo + k]
            at = np.minimum(np.searchsorted(self.steps, keys), len(self.steps) - 1)
            on = self.steps[at] == keys
            row, lo, node = row[on], lo[on], self.leads[at[on]]
            piece = self.ends[node]
            whole = piece >= 0
            out[row[whole], lo[whole] + k + 1, k] = piece[whole]
            on = lo + k + 1 < n
            row, lo, node = row[on], lo[on], node[on]
        return out

    def spelt(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Lattice and lengths of words as the vocabulary writes them, with its mark of a word's start."""
        marked = [_WORD_START + w for w in words]
        return self.lattice(marked), np.array([len(w) for w in marked])

    @staticmethod
    def groups(words: list[str]) -> Iterator[list[str]]:
        """Words of like lengths together, with a bounded lattice."""
        words = sorted(words, key=len)
        while words:
            k = min(len(words), 2000)
            while k > 1 and (k * len(words[k - 1]) > 60_000 or len(words[k - 1]) > 2 * len(words[0])):
                k //= 2
            yield words[:k]
            words = words[k:]


@lru_cache(1)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def forward(lattice: np.ndarray, chances: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Natural log of the summed probability of each word in each language.

    chances: piece by language, with a last row of zeros for "no piece". Sums
    that grow too small are lifted, for each word and language by itself, so a
    word of any length keeps its precision.
    """
    words, places, back = lattice.shape
    sums = np.zeros((back, words, chances.shape[1]))  # those of the last places, by place modulo their number
    sums[0] = 1
    logs, out = np.zeros(sums.shape[1:]), np.zeros(sums.shape[1:])
    for at in range(1, places):
        total = np.zeros(sums.shape[1:])
        for k in range(min(back, at)):
            ids = lattice[:, at, k]
            if (ids >= 0).any():
                total += sums[(at - k - 1) % back] * chances[ids]
        low = (total < _TINY) & (total > 0)
        if low.any():
            lift = np.where(low, _LIFT, 1.0)
            sums *= lift
            total *= lift
            logs -= np.log(lift)
        sums[at % back] = total
        done = lengths == at
        if done.any():
            out[done] = np.log(total[done]) + logs[done]
    return out


def expected(lattice: np.ndarray, lengths: np.ndarray, share: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word, piece and expected uses, when every piece has the probability `share`.

    Both sums are divided by their value at each place, whose log is kept, so a
    word of any length stays in range.
    """
    words, places, back = lattice.shape
    ahead, behind = np.zeros((places, words)), np.zeros((places, words))
    scale = np.zeros((places, words))  # log of what `ahead` was divided by up to a place
    ahead[0] = 1
    for at in range(1, places):
        top = scale[at - 1]
        total = np.zeros(words)
        for k in range(min(back, at)):
            total += np.where(lattice[:, at, k] >= 0, ahead[at - k - 1] * np.exp(scale[at - k - 1] - top) * share, 0)
        norm = np.where(total > 0, total, 1)
        ahead[at], scale[at] = total / norm, top + np.log(norm)
    behind[lengths, np.arange(words)] = 1
    after = np.zeros((places, words))
    rows, found, uses = [], [], []
    for at in range(places - 1, 0, -1):
        inside = lengths >= at
        if at < places - 1:
            total = behind[at].copy()
            for k in range(back):
                if at + k + 1 < places:
                    step = np.where(lattice[:, at + k + 1, k] >= 0, behind[at + k + 1] * np.exp(after[at + k + 1] - after[at + 1]) * share, 0)
                    total += np.where(lengths > at, step, 0)
            shift = np.where(lengths > at, after[at + 1], 0)
            norm = np.where(total > 0, total, 1)
            behind[at], after[at] = total / norm, shift + np.log(norm)
        whole = scale[lengths, np.arange(words)]
        for k in range(min(back, at)):
            own = inside & (lattice[:, at, k] >= 0)
            if own.any():
                chance = ahead[at - k - 1] * behind[at] * share * np.exp(np.minimum(scale[at - k - 1] + after[at] - whole, 700))
                rows.append(np.flatnonzero(own))
                found.append(lattice[own, at, k])
                uses.append(chance[own])
    return np.concatenate(rows), np.concatenate(found), np.concatenate(uses)


_PLAIN = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def words_of(text: str) -> list[str]:
    return text.encode().translate(_PLAIN).decode().lower().split()


def _count_task(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = pieces(path)
        counts: dict[str, Counter] = defaultdict(Counter)

        def drain() -> Iterator[pa.RecordBatch]:
            langs = list(counts)
            uses = np.zeros((len(langs), vocabulary.size))
            for group in Pieces.groups(list(set().union(*counts.values()))):
                lattice, lengths = vocabulary.spelt(group)
                row, piece, n = expected(lattice, lengths, 1 / vocabulary.size)
                for k, lang in enumerate(langs):
                    times = np.array([counts[lang].get(w, 0) for w in group])
                    uses[k] += np.bincount(piece, n * times[row], vocabulary.size)
            for k, lang in enumerate(langs):
                some = np.flatnonzero(uses[k])
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), pa.array(some, pa.int32()), pa.array(uses[k][some])], ["lang", "piece", "uses"])
            counts.clear()

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                counts[lang].update(words_of(text))
            if sum(map(len, counts.values())) > COUNT_WORDS:
                yield from drain()
        if counts:
            yield from drain()

    return run


def learn(docs: DataFrame, path: str, train: Column, key: str = "doc_id", text: str = "text", lang: str = "lang") -> tuple[list[str], np.ndarray]:
    """The languages of the training rows, and the probability of each piece in each of them.

    One number per piece and language comes back: the vocabulary is fixed, so the
    model does not grow with the documents.
    """
    known = docs.filter(train & F.col(lang).isNotNull() & F.col(text).isNotNull())
    part = F.pmod(F.xxhash64(key, F.lit("fit")), F.lit(1 << 30)) / (1 << 30)
    known = known.select(F.col(lang).alias("lang"), F.col(text).alias("text"), part.alias("part"))  # whatever else there is stays behind
    shares = known.groupBy("lang").agg((SAMPLE_ROWS / F.count("*")).alias("share"))
    rows = known.join(F.broadcast(shares), "lang").filter("part <= share").select("lang", "text")  # a row for each language
    sums = rows.mapInArrow(_count_task(path), "lang string, piece int, uses double").groupBy("lang", "piece").agg(F.sum("uses").alias("uses"))
    got = sums.toPandas()
    langs = sorted(got["lang"].unique())
    counts = np.zeros((len(langs), pieces(path).size))
    counts[np.searchsorted(langs, got["lang"].to_numpy(str)) if len(got) else [], got["piece"].to_numpy(int)] = got["uses"].to_numpy()
    counts += SMOOTHING
    chances = counts / counts.sum(axis=1, keepdims=True)
    return langs, np.vstack([chances.T, np.zeros(len(langs))])


class Scorer:
    """Log probabilities of texts; a word's forward sums are kept."""

    def __init__(self, path: str, chances: np.ndarray):
        self.pieces, self.chances = pieces(path), chances
        self.place: dict[str, int] = {}
        self.rows = np.zeros((1024, chances.shape[1]))

    def _sums(self, words: list[str]) -> tuple[list[str], np.ndarray]:
        order, found = [], []
        for group in Pieces.groups(words):
            lattice, lengths = self.pieces.spelt(group)
            order += group
            found.append(forward(lattice, self.chances, lengths))
        return order, np.concatenate(found)

    def texts(self, texts: list[list[str]]) -> np.ndarray:
        if len(self.place) > CACHE_WORDS:  # short words recur, so they stay
            short = [w for w in self.place if len(w) <= 6][: CACHE_WORDS // 4]
            kept = self.rows[[self.place[w] for w in short]]
            self.rows[: len(short)] = kept
            self.place = dict(zip(short, range(len(short))))
        seen = set().union(*texts)
        long = {w for w in seen if len(w) > CACHE_LENGTH}
        extra: dict[str, np.ndarray] = dict(zip(*self._sums(list(long)))) if long else {}
        if new := [w for w in seen if w not in self.place and w not in long]:
            words, sums = self._sums(new)
            lo, hi = len(self.place), len(self.place) + len(new)
            if hi > len(self.rows):
                self.rows = np.concatenate([self.rows[:lo], np.zeros((2 * hi - lo, self.rows.shape[1]))])
            self.rows[lo:hi] = sums
            self.place.update(zip(words, range(lo, hi)))
        out = np.zeros((len(texts), self.chances.shape[1]))
        place = self.place
        for k, words in enumerate(texts):
            if long and not long.isdisjoint(words):
                out[k] = sum(extra[w] for w in words if w in long)
                words = [w for w in words if w not in long]
            if words:
                out[k] += self.rows[[place[w] for w in words]].sum(axis=0)
        return out


_SCORERS: dict[str, Scorer] = {}


def _score(path: str, langs: list[str], model, key: str, text: str):
    def make():
        take_over("language_id", _SCORERS.clear)
        if key not in _SCORERS:  # one model at a time, kept for the worker's next tasks
            _SCORERS.clear()
            _SCORERS[key] = Scorer(path, model.value)
        scorer = _SCORERS[key]

        def step(batch: pa.RecordBatch) -> list[pa.Array]:
            texts = batch.column(text).to_pylist()
            known = [bool(langs) and t is not None and _LETTER.search(t) is not None for t in texts]
            picked, scores = [], []
            for lo in range(0, len(texts), 500):
                logs = scorer.texts([words_of(t) if ok else [] for t, ok in zip(texts[lo : lo + 500], known[lo : lo + 500])])
                for row, ok in zip(logs, known[lo : lo + 500]):
                    if not ok:
                        picked.append(UNKNOWN)
                        scores.append(0.0)
                        continue
                    best = int(row.argmax())
                    picked.append(langs[best])
                    scores.append(float(1 / np.exp(row - row[best]).sum()))
            return [pa.array(picked, pa.string()), pa.array(scores, pa.float64())]

        return step

    return make


def identify(docs: DataFrame, path: str, train: Column, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """`docs` with lang_pred and score, the share of the best language's probability.

    The model is learnt from the rows of `docs` where `train` holds and neither
    text nor language is null. A null text, or one without a letter, is `und`
    with score 0, and so is every text if nothing could be learnt. Equal
    probabilities go to the language that sorts first. Repeated rows are judged
    alike; columns of the same names are replaced, all others pass through.
    """
    langs, chances = learn(docs, path, train, key, text, lang)
    model = docs.sparkSession.sparkContext.broadcast(chances)  # vocabulary x languages
    key = f"{docs.sparkSession.sparkContext.applicationId}-{id(model)}-{chances.sum()!r}"
    return annotate(docs, _score(path, langs, model, key, text), "lang_pred string, score double")


def public_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = held_out(F.col("doc_id"), 4, 2)
    out = identify(docs, public_vocabulary(), ~held)
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score")


QUERIES = {"op9_language_id": op9_language_id}
SQL: dict[str, str] = {}
