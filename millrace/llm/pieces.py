"""SentencePiece encoding and decoding for merge-type (BPE) models."""

from __future__ import annotations

import re
from array import array
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import lean, numbered, once, release, table
from millrace.llm.words import Table

MARK = "▁"
#: Chunks of text whose ids a worker keeps, if they have at most so many characters.
CHUNKS, WIDE = 1 << 18, 40
#: Bytes of text, or ids, that are looked up at once, about.
AT_ONCE = 600_000
#: Adjacent pairs whose compatibility a worker keeps.
PAIRS = 400_000


@lru_cache(maxsize=4)
def load_pieces(model_file: str) -> dict:
    """The vocabulary of a model file as plain lists, small enough for a broadcast: its size is fixed by
    the model. Raises ValueError for models that this encoder doesn't cover."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto()
    with open(model_file, "rb") as f:
        proto.ParseFromString(f.read())
    norm = proto.normalizer_spec
    kinds = [p.type for p in proto.pieces]
    if proto.trainer_spec.model_type != 2 or norm.name != "identity" or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix or not proto.trainer_spec.byte_fallback or proto.trainer_spec.treat_whitespace_as_suffix or {4, 5} & set(kinds):
        raise ValueError("needs a BPE model with byte fallback, identity normalisation and a dummy prefix")
    return {"pieces": [p.piece for p in proto.pieces], "scores": [p.score for p in proto.pieces], "kinds": kinds}


class PieceCodec:
    """Encodes and decodes exactly as the library does, one text at a time.

    A chunk's tokens are found from the left: at each position the longest piece is tried first, then its
    prefixes. A piece is accepted if it is compatible with the token before it, that is, if merging the
    two pieces' characters anew gives the same two pieces. A position from which no piece fits is marked
    in a bitfield and never tried again. Longest matches come from an Aho-Corasick automaton, which runs from the
    left, and again from a position that none of the matches so far begins at, until it meets them.
    Only pieces that merging their own characters gives back can occur in an encoding.
    """

    def __init__(self, pieces: list[str], scores: list[float], kinds: list[int], own: list[int] | None = None):
        import ahocorasick

        self.pieces, self.kinds, self.size = pieces, kinds, [len(p) for p in pieces]
        self.ids = {p: i for i, (p, k) in enumerate(zip(pieces, kinds, strict=True)) if k == 1}
        self.score = {p: scores[i] for p, i in self.ids.items()}
        self.byte = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(pieces, kinds, strict=True)) if k == 6}
        self.control = [i for i, k in enumerate(kinds) if k == 3]
        self.end, self.pairs, self.chars = pieces.index("</s>"), {}, {p for p in self.ids if len(p) == 1}
        many = [p for p in self.ids if len(p) > 1]
        if any(not self.chars.issuperset(p) for p in many):
            raise ValueError("a piece holds a character that is no piece")
        split = not any(MARK in p.lstrip(MARK) for p in many)
        self.cut = split and not any(c in p for p in many for c in "\n\t")
        self.chunk = re.compile(f"{MARK}+[^{MARK}\n\t]*|[^{MARK}\n\t]+|[\n\t]" if self.cut else "(?s).+").findall
        self.own = own if own is not None else [i for p, i in self.ids.items() if self.merge(p) == [i]]
        self.auto, real = ahocorasick.Automaton(), {pieces[i]: i for i in self.own}
        self.shorter = {}
        for p, i in real.items():
            self.auto.add_word(p, i)
            self.shorter[i] = next((real[p[:n]] for n in range(len(p) - 1, 0, -1) if p[:n] in real), None)
        self.auto.make_automaton()
        self.surface = [p.replace(MARK, " ").encode() if k == 1 else bytes([int(p[3:5], 16)]) if k == 6 else " ⁇ ".encode() if k == 2 else b"" for p, k in zip(pieces, kinds, strict=True)]

    def merge(self, s: str) -> list[int]:
        """Merges neighbours, best score first and leftmost among equals, until none makes a piece."""
        parts, score = list(s), self.score
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                v = score.get(parts[k] + parts[k + 1])
                if v is not None and (best is None or v > best):
                    best, at = v, k
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ids[p] for p in parts]

    def fits(self, a: int, b: int) -> bool:
        key = a << 20 | b
        if (v := self.pairs.get(key)) is None:
            if len(self.pairs) > PAIRS:
                self.pairs.clear()
            v = self.pairs[key] = self.merge(self.pieces[a] + self.pieces[b]) == [a, b]
        return v

    def known(self, s: str) -> list[int]:
        """Tokens of a string whose characters are all pieces."""
        n, longest = len(s), [None] * (len(s) + 1)
        self._matches(s, 0, longest)
        open_at, tokens, pos, token, last = bytearray(b"\1") * (len(s) + 1), [], 0, longest[0], -1
        size, shorter, pairs = self.size, self.shorter, self.pairs
        while token is not None:
            end, fits = pos + size[token], last < 0
            if open_at[end] and not fits and (fits := pairs.get(last << 20 | token)) is None:
                fits = self.fits(last, token)
            if fits and open_at[end]:
                tokens.append(token)
                pos, last, token = end, token, longest[end]
                if token is None and end < n:
                    token = self._matches(s, end, longest)
            elif (token := shorter[token]) is None:
                open_at[pos] = 0
                token = tokens.pop()
                pos, last = pos - size[token], tokens[-1] if tokens else -1
        return tokens

    def _matches(self, s: str, pos: int, longest: list):
        """The longest piece at `pos`; fills `longest` with it and those that follow end to end, as far as they
        aren't there yet."""
        for end, i in self.auto.iter_long(s, pos):
            at = end + 1 - self.size[i]
            if longest[at] is not None:
                break
            longest[at] = i
        return longest[pos]

    def encode_chunk(self, s: str) -> list[int]:
        if self.chars.issuperset(s):
            return self.known(s)
        out, run = [], ""
        for c in s:  # a character that is no piece joins nothing: it becomes its bytes
            if c in self.chars:
                run += c
            else:
                out += self.known(run) if run else []
                run = ""
                out += [self.byte[x] for x in c.encode()]
        return out + (self.known(run) if run else [])

    def chunks(self, text: str) -> list[str]:
        return self.chunk(MARK + text.replace(" ", MARK)) if text else []

    def decode(self, ids) -> str:
        raw = [self.surface[i] for i in ids]
        first = next((k for k, i in enumerate(ids) if self.kinds[i] != 3), None)
        if first is not None and self.kinds[ids[first]] == 1 and raw[first][:1] == b" ":
            raw[first] = raw[first][1:]
        if not any(i in ids[:-1] for i in self.control):
            try:
                return b"".join(raw).decode()
            except UnicodeDecodeError:
                pass
        return "".join(self._runs(ids, raw))

    def _runs(self, ids, raw):
        """Runs of bytes, which any other id ends, are read as UTF-8; a byte that is part of no character is U+FFFD."""
        run = b""
        for i, r in zip([*ids, None], [*raw, b""], strict=True):
            if i is not None and self.kinds[i] == 6:
                run += r
                continue
            while run:
                for n in (1, 2, 3, 4):
                    try:
                        c = run[:n].decode()
                        break
                    except UnicodeDecodeError:
                        c = "�"
                else:
                    n = 1
                yield c
                run = run[n:]
            yield r.decode()


class Encoder:
    """Encodes many texts. The ids of the chunks seen last are kept; a chunk is found by its characters, never by
    a hash of them."""

    def __init__(self, codec: PieceCodec):
        self.codec, code = codec, "H" if len(codec.pieces) <= 1 << 16 else "i"
        self.kind = np.dtype(code)
        self.packed = Table(lambda chunk: array(code, codec.encode_chunk(chunk.replace(" ", MARK))).tobytes(), CHUNKS, WIDE)
        # What `chunks` finds in a text without marks, before its blanks become marks.
        self.split = re.compile(" +[^ \n\t]*|[^ \n\t]+|[\n\t]" if codec.cut else "(?s).+").findall

    def _one(self, text: str) -> bytes:
        if MARK in text:
            return np.array([i for c in self.codec.chunks(text) for i in self.codec.encode_chunk(c)], self.kind).tobytes()
        return b"".join(map(self.packed.__getitem__, self.split(" " + text)))  # with the dummy prefix

    def encode(self, texts: list[str], last: list[int]):
        """(ids of all texts one after the other, where each text's begin). `last` ends each text."""
        tail = np.array(last, self.kind).tobytes()
        rows = [(self._one(t) if t else b"") + tail for t in texts]
        ends = np.cumsum([0, *(len(r) // self.kind.itemsize for r in rows)])
        return np.frombuffer(b"".join(rows), self.kind).astype(np.int32), ends


def _codec(key: str, vocabulary) -> Encoder:
    v = vocabulary.value
    return once(("pieces", key), lambda: Encoder(PieceCodec(v["pieces"], v["scores"], v["kinds"], v["own"])))


def _vocabulary(spark, model_file: str):
    v = load_pieces(model_file)
    if "own" not in v:
        v["own"] = PieceCodec(v["pieces"], v["scores"], v["kinds"]).own
    return spark.sparkContext.broadcast(v)


def _map(df: DataFrame, model_file: str, column: str, out: dict[str, T.DataType], each) -> DataFrame:
    """`df` with the columns `out` made from `column` by each(encoder, values) -> Arrow arrays, batch by batch."""
    import pyarrow as pa
    import pyarrow.compute as pc

    given = [c for c in df.columns if c not in out]
    df, names = numbered(df, given, column)
    made = [f"o{i}" for i in range(len(out))]
    schema = T.StructType([df.schema[c] for c in names] + [T.StructField(c, kind) for c, kind in zip(made, out.values(), strict=True)])
    vocabulary = _vocabulary(df.sparkSession, model_file)

    def run(batches):
        encoder = _codec(model_file, vocabulary)
        for b in batches:
            size = b.column("text").value_lengths() if pa.types.is_list(b.column("text").type) else pc.binary_length(b.column("text"))
            ends, lo = np.cumsum(size.fill_null(0).to_numpy(zero_copy_only=False)), 0
            while lo < b.num_rows:  # a slice of rows bounds what stands in memory beside the batch
                done = ends[lo - 1] if lo else 0
                part = b.slice(lo, max(1, int(np.searchsorted(ends, done + AT_ONCE, side="right")) - lo))
                lo += part.num_rows
                yield pa.RecordBatch.from_arrays([part.column(c) for c in names] + each(encoder, part.column("text")), names=[*names, *made])
        release()

    lean(df.sparkSession)
    return df.mapInArrow(run, schema).toDF(*given, *out)


IDS = T.ArrayType(T.IntegerType())


def _encoded(encoder: Encoder, texts, end: bool):
    import pyarrow as pa

    ids, ends = encoder.encode(texts.to_pylist(), [encoder.codec.end] * end)
    return pa.ListArray.from_arrays(pa.array(ends.astype("i4")), pa.array(ids))


def _decoded(encoder: Encoder, lists):
    import pyarrow as pa

    flat = lists.flatten()
    if flat.null_count:
        return pa.array([encoder.codec.decode([i for i in x if i is not None] if x else []) for x in lists.to_pylist()], pa.string())
    size = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    ends, ids = np.cumsum(size), flat.to_numpy().tolist()
    return pa.array([encoder.codec.decode(ids[e - n : e]) for e, n in zip(ends.tolist(), size.tolist(), strict=True)], pa.string())


def encode(docs: DataFrame, model_file: str, text_col: str = "text", out_col: str = "ids", end: bool = True) -> DataFrame:
    """`docs` with `out_col`: the ids (array of int) that the sentencepiece library gives for the whole text,
    with an end id if `end` and without sampling. A column of that name is replaced.

    Texts are cut where no piece can join the two sides, and a worker keeps the ids of the chunks it saw last,
    by their characters. No shuffle; every row is handled alone, so repeated rows give equal results. Null counts
    as empty; the empty text has the end id only.
    """

    return _map(docs, model_file, text_col, {out_col: IDS}, lambda encoder, texts: [_encoded(encoder, texts, end)])


def decode(rows: DataFrame, model_file: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """`rows` with `out_col`: the text that the library's decode(ids) gives. A column of that name is
    replaced. Null ids give the empty text; null elements are skipped; ids outside the vocabulary raise."""

    return _map(rows, model_file, ids_col, {out_col: T.StringType()}, lambda encoder, lists: [_decoded(encoder, lists)])


def round_trip(docs: DataFrame, model_file: str, text_col: str = "text", ids_col: str = "ids", decoded_col: str = "decoded") -> DataFrame:
    """`docs` with the ids of `encode` and the text that `decode` gives back for them, in one pass: one
    Python worker for each task instead of two."""

    def each(encoder, texts):
        ids = _encoded(encoder, texts, True)
        return [ids, _decoded(encoder, ids)]

    return _map(docs, model_file, text_col, {ids_col: IDS, decoded_col: T.StringType()}, each)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def piece_digests(docs: DataFrame, model_file: str) -> DataFrame:
    """One row per document (doc_id, text): n_tokens, ids_sha256, decoded_sha256."""
    rows = round_trip(docs.select("doc_id", "text"), model_file)
    spaced = F.array_join(F.col("ids").cast("array<string>"), " ")
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(spaced.cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op8_sentencepiece(spark, sf_dir):
    return piece_digests(table(spark, sf_dir, "documents").select("doc_id", "text"), default_model())


QUERIES = {"op8_sentencepiece": op8_sentencepiece}
SQL: dict = {}
