"""Language identification by segmentation-marginalised unigrams."""

from __future__ import annotations

import math
import re
import uuid

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import column, lean, numbered, once, release, table
from millrace.llm.pieces import MARK, default_model, load_pieces
from millrace.llm.words import FACTOR

#: Words whose scores a worker keeps.
CACHE = 1 << 18
#: Longer words are scored by the running forward pass, which rescales, and fitted in logarithms.
LONG = 40
#: Words in one block of the forward pass, and characters of text, about, whose words are looked up at once.
BLOCK, CHARS = 8192, 600_000
#: What stands between words, a line end, is in none.
GAP = 10
#: Bits of the tables of pieces' beginnings.
TABLE = 20
#: What may be a letter: numerals that aren't decimal digits are in it too.
LETTER = re.compile(r"[^\W\d_]")


def has_letter(text: str) -> bool:
    """Whether a character is of Unicode's category L."""
    return any(m[0].isalpha() for m in LETTER.finditer(text))


def byte_piece(b: int) -> str:
    """Stands for the piece of one byte, a character that no text holds."""
    return chr(0xDC00 + b)


def vocabulary_of(model_file: str) -> list[str]:
    """The pieces of the fixed vocabulary: strings, and the bytes that cover every other character."""
    v = load_pieces(model_file)
    return [byte_piece(int(p[3:5], 16)) if k == 6 else p for p, k in zip(v["pieces"], v["kinds"], strict=True) if k in (1, 6)]


def held_out(id_col: str, modulus: int, remainder: int):
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % modulus == remainder


class Segmenter:
    """All segmentations of many words into pieces of a fixed vocabulary, at once.

    Words stand one after the other as code points with a gap between. Windows grow by one character from
    every position, under a rolling hash, as long as a table says that some piece may begin so; windows that
    have a piece's hash and are that piece, character by character, are the arcs (word, begin, length, piece). A
    character that is no piece stands as its bytes' pieces (see byte_piece); if the vocabulary has none, it is
    left out.
    """

    def __init__(self, pieces: list[str]):
        cps = [np.frombuffer(p.encode("utf-32-le", "surrogatepass"), np.uint32) for p in pieces]
        self.bytes = {byte_piece(b) for b in range(256)} <= set(pieces)
        self.letters = np.zeros((len(cps), max(map(len, cps))), np.uint32)
        for i, c in enumerate(cps):
            self.letters[i, : len(c)] = c
        self.known, self.longest = np.zeros(0x110000, bool), max(map(len, cps))
        self.known[[c[0] for c in cps if len(c) == 1]] = True
        self.begins, self.ends = np.zeros(1 << TABLE, bool), np.zeros(1 << TABLE, bool)
        hashes = np.zeros(len(cps), np.uint64)
        for i, c in enumerate(cps):
            h = 0
            for x in c.tolist():
                h = (h + x) * FACTOR % 2**64
                self.begins[h >> (64 - TABLE)] = True
            self.ends[h >> (64 - TABLE)] = True
            hashes[i] = h
        self.order = np.argsort(hashes)
        self.hashes = hashes[self.order]

    def arcs(self, words: list[str]):
        """(lengths of the words, then word, begin, length and piece of every arc)."""
        text = "\n".join([*words, ""])
        cp = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        if self.bytes and len(other := np.unique(cp[~self.known[cp] & (cp != GAP)])):
            text = text.translate({c: "".join(map(byte_piece, chr(c).encode())) for c in other.tolist()})
            cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        cp = cp[self.known[cp] | (cp == GAP)]
        gaps = np.flatnonzero(cp == GAP)
        first = np.concatenate([[0], gaps[:-1] + 1])
        word = np.repeat(np.arange(len(words)), gaps - first + 1)
        at, found = np.flatnonzero(cp != GAP), []
        wide = cp.astype(np.uint64)
        h = np.zeros(len(at), np.uint64)
        for n in range(1, self.longest + 1):
            c = wide[at + (n - 1)]
            h = (h + c) * np.uint64(FACTOR)
            top = h >> np.uint64(64 - TABLE)
            on = self.begins[top] & (c != GAP)
            hit = np.flatnonzero(on & self.ends[top])
            k = np.minimum(np.searchsorted(self.hashes, h[hit]), len(self.hashes) - 1)
            same = self.hashes[k] == h[hit]
            begin, piece = at[hit[same]], self.order[k[same]]
            real = np.ones(len(begin), bool)
            for j in range(n):
                real &= cp[begin + j] == self.letters[piece, j]
            found.append((begin[real], np.full(int(real.sum()), n), piece[real]))
            at, h = at[on], h[on]
            if not len(at):
                break
        begin, length, piece = (np.concatenate(x) for x in zip(*found, strict=True))
        return gaps - first, word[begin], begin - first[word[begin]], length, piece

    def steps(self, words: list[str]):
        """The words' lengths, and the arcs by their end and length: (end, words, begins, pieces). No two of
        one step belong to the same word."""
        size, word, begin, length, piece = self.arcs(words)
        key = ((begin + length) * 32 + length).astype(np.uint16)
        order = np.argsort(key, kind="stable")
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(key[order])) + 1, [len(order)]])
        parts = [order[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True) if b > a]
        return size, [(int(begin[p[0]] + length[p[0]]), word[p], begin[p], piece[p]) for p in parts]

    def forward(self, words: list[str], probs):
        """Natural log of the sum over segmentations of the product of the pieces' probabilities, for each
        word (row) and language (column of probs)."""
        out = np.zeros((len(words), probs.shape[1]))
        short = [k for k, w in enumerate(words) if len(w) <= LONG]
        for k in set(range(len(words))) - set(short):
            out[k] = self.running(words[k], probs)
        for lo in range(0, len(short), BLOCK):
            rows = short[lo : lo + BLOCK]
            size, steps = self.steps([words[k] for k in rows])
            out[rows] = np.log(self._alpha(size, steps, probs)[size, np.arange(len(rows))])
        return out

    @staticmethod
    def _alpha(size, steps, probs):
        alpha = np.zeros((int(size.max(initial=0)) + 1, len(size), probs.shape[1]))
        alpha[0] = 1.0
        for end, word, begin, piece in steps:
            alpha[end, word] += alpha[begin, word] * probs[piece]
        return alpha

    def running(self, word: str, probs):
        """The same for one word of any length, rescaled as it goes."""
        size, _, begin, length, piece = self.arcs([word])
        order = np.argsort(begin + length, kind="stable")
        alpha, scale, seen = {0: np.ones(probs.shape[1])}, np.zeros(probs.shape[1]), 0
        for start, end, p in zip(begin[order].tolist(), (begin + length)[order].tolist(), piece[order].tolist(), strict=True):
            if end != seen:
                top = alpha[seen]
                scale += np.log(top)
                alpha = {k: v / top for k, v in alpha.items() if k > end - 64}
                seen = end
            alpha[end] = alpha.get(end, 0.0) + alpha[start] * probs[p]
        return scale + np.log(alpha[int(size[0])])

    def fit(self, words: list[str], counts, size: int, rounds: int, smooth: float):
        """Piece probabilities of one language by EM: the pieces' expected counts over all segmentations of
        the words, smoothed, again and again."""
        short = [k for k, w in enumerate(words) if len(w) <= LONG]
        long = [k for k, w in enumerate(words) if len(w) > LONG]
        rows = [short[lo : lo + BLOCK] for lo in range(0, len(short), BLOCK)]
        blocks = [(np.array([counts[k] for k in r], float), *self.steps([words[k] for k in r])) for r in rows]
        prob = np.full((size, 1), 1.0 / size)
        for _ in range(rounds):
            total = np.full(size, smooth)
            for count, n, steps in blocks:
                rows = np.arange(len(n))
                alpha = self._alpha(n, steps, prob)[..., 0]
                beta = np.zeros_like(alpha)
                beta[n, rows] = 1.0
                weight = count / alpha[n, rows]
                for end, word, begin, piece in reversed(steps):
                    p = prob[piece, 0]
                    np.add.at(total, piece, weight[word] * alpha[begin, word] * p * beta[end, word])
                    beta[begin, word] += beta[end, word] * p
            for k in long:
                self._expect(words[k], counts[k], prob[:, 0], total)
            prob = (total / total.sum())[:, None]
        return prob[:, 0]

    def _expect(self, word: str, count, prob, total) -> None:
        """Adds to `total` the pieces' expected counts over all segmentations of one word of any length."""
        size, _, begin, length, piece = self.arcs([word])
        n, end, logs = int(size[0]), begin + length, np.log(prob[piece])
        fore, back = self._logs(n, begin, end, logs), self._logs(n, n - end, n - begin, logs)[::-1]
        np.add.at(total, piece, count * np.exp(fore[begin] + logs + back[end] - fore[n]))

    @staticmethod
    def _logs(n: int, begin, end, logs):
        """The log of the sum over paths of arcs from 0 to each position."""
        order = np.argsort(end, kind="stable")
        cuts = np.searchsorted(end[order], np.arange(1, n + 2)).tolist()
        start, step, out = begin[order].tolist(), logs[order].tolist(), [0.0]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            x = [out[start[i]] + step[i] for i in range(lo, hi)]
            top = max(x)
            out.append(top + math.log(sum(math.exp(v - top) for v in x)))
        return np.array(out)


def fit_languages(docs: DataFrame, model_file: str, docs_per_lang: int = 150, rounds: int = 4, smooth: float = 0.02, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang"):
    """(languages, probabilities [piece, language]) from the rows with text and language.

    The fit takes a bounded sample: about `docs_per_lang` whole documents of each language, those whose
    hash of the id is lowest, so that reruns agree. Their words are counted on the executors and fitted by
    EM, one task for each language; only piece probabilities reach the driver (languages x vocabulary).
    """
    pieces = vocabulary_of(model_file)
    vocabulary = docs.sparkSession.sparkContext.broadcast(pieces)
    lean(docs.sparkSession)
    rows = docs.where(column(lang_col).isNotNull() & column(text_col).isNotNull()).select(column(lang_col).alias("lang"), column(text_col).alias("text"), F.xxhash64(F.lit(seed), column(id_col)).alias("h"))
    share = {r["lang"]: min(1.0, docs_per_lang / r["n"]) for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(share)
    if not langs:
        return [], np.zeros((len(pieces), 0)), vocabulary
    kept = None
    for k, s in share.items():
        c = (F.col("lang") == k) & (F.col("h") <= F.lit(int(-(2**63) + s * (2**64 - 2**12))))
        kept = c if kept is None else kept | c

    def count(frames):
        import pandas as pd

        for f in frames:
            rows = [(k, w, n) for k, t in zip(f["lang"], f["text"], strict=True) for w, n in _counter(t).items()]
            yield pd.DataFrame(rows, columns=["lang", "word", "n"])

    def fit(key, frame):
        import pandas as pd

        prob = Segmenter(vocabulary.value).fit(frame["word"].tolist(), frame["n"].tolist(), len(vocabulary.value), rounds, smooth)
        return pd.DataFrame({"lang": [key[0]] * len(prob), "piece": np.arange(len(prob)), "p": prob})

    words = rows.where(kept).select("lang", "text").mapInPandas(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    probs = np.zeros((len(pieces), len(langs)))
    for r in words.groupBy("lang").applyInPandas(fit, "lang string, piece int, p double").groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("piece", "p"))).alias("x")).collect():
        probs[:, langs.index(r["lang"])] = [x["p"] for x in r["x"]]
    return langs, probs, vocabulary


def _counter(text: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for w in text.lower().encode().split():
        w = MARK + w.decode()
        out[w] = out.get(w, 0) + 1
    return out


class Scorer:
    """Words' scores in all languages. Those of the words seen last are kept; a word is found by its bytes,
    never by a hash of them."""

    def __init__(self, pieces: list[str], probs):
        self.seg, self.probs = Segmenter(pieces), probs
        self.rows, self.logs = {}, np.zeros((1 << 14, probs.shape[1]))

    def totals(self, texts: list[str]):
        """The sum of the words' scores of each text."""
        words = [t.lower().encode().split() for t in texts]
        if len(self.rows) > CACHE:
            self.rows, self.logs = {}, np.zeros((1 << 14, self.probs.shape[1]))
        rows, known = self.rows, len(self.rows)
        new = [w for w in dict.fromkeys(w for ws in words for w in ws) if w not in rows]
        if new:
            if known + len(new) > len(self.logs):
                self.logs = np.concatenate([self.logs, np.zeros((known + len(new), self.probs.shape[1]))])
            self.logs[known : known + len(new)] = self.seg.forward([MARK + w.decode() for w in new], self.probs)
            rows.update(zip(new, range(known, known + len(new)), strict=True))
        ends = np.cumsum([0, *map(len, words)])
        at = np.fromiter((rows[w] for ws in words for w in ws), np.int64, int(ends[-1]))
        out, some = np.zeros((len(texts), self.probs.shape[1])), np.flatnonzero(np.diff(ends))
        out[some] = np.add.reduceat(self.logs[at], ends[:-1][some]) if len(some) else 0.0
        return out


def identify(docs: DataFrame, model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with lang_pred and score (which replace columns so named), from `model` of fit_languages.

    The text is lower-cased and split at blanks; a word's probability in a language is the sum over
    all its segmentations into pieces, and the language's posterior under equal priors is the score. `und`
    with score 0 if the text is null or has no letter, or nothing was learned. Ties go to the language
    that sorts first. Rows are handled alone: no shuffle, whole texts, repeated rows alike.
    """
    import pyarrow as pa
    from pyspark.sql import types as T

    langs, probs, vocabulary = model
    given = [c for c in docs.columns if c not in ("lang_pred", "score")]
    docs, names = numbered(docs, given, text_col)
    schema = T.StructType([docs.schema[c] for c in names] + [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    table_ = docs.sparkSession.sparkContext.broadcast(probs)
    key = uuid.uuid4().hex

    def run(batches):
        scorer = once(("language", key), lambda: Scorer(vocabulary.value, table_.value))
        for b in batches:
            lo = 0
            while lo < b.num_rows:
                hi, held, texts = lo, 0, []
                while hi < b.num_rows and (hi == lo or held < CHARS):
                    texts.append(b.column("text")[hi].as_py())
                    held, hi = held + len(texts[-1] or ""), hi + 1
                asked = [k for k, t in enumerate(texts) if t and langs and has_letter(t)]
                pred, score = ["und"] * len(texts), [0.0] * len(texts)
                if asked:
                    for k, total in zip(asked, scorer.totals([texts[k] for k in asked]), strict=True):
                        best = int(total.argmax())
                        pred[k], score[k] = langs[best], 1.0 / float(np.exp(np.maximum(total - total[best], -700.0)).sum())
                part = b.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([part.column(c) for c in names] + [pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=[*names, "lang_pred", "score"])
                lo = hi
        release()

    lean(docs.sparkSession)
    return docs.mapInArrow(run, schema).toDF(*given, "lang_pred", "score")


def op7_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = fit_languages(docs.where(~held_out("doc_id", 4, 2)), default_model())
    rows = docs.select("doc_id", "text", held_out("doc_id", 4, 2).alias("held_out"))
    return identify(rows, model).select("doc_id", "held_out", "lang_pred", "score")


QUERIES = {"op7_language_id": op7_language_id}
SQL: dict = {}
