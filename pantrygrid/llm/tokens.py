"""Token counts, and byte-level BPE encoding and decoding.

Both run in Arrow functions. A batch of rows is cut into slices of at most a set number of bytes, so that a slice costs
the same whether its texts are many or long, and texts are cut at safe boundaries: for counts at spaces, so that a piece
that comes again is counted once, for encoding into parts that the library handles one by one. A boundary is safe where
the pre-splitting pattern of the vocabulary ends a match whatever stands on either side: before a single space between
two letters or digits (a space opens the match that follows it), before a run of white space, and before the last
character of such a run when it has two or more (the run without its last character is a match of its own if anything
follows). A text without such a place stays whole.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pantrygrid.llm import shared

#: Bytes of a part of a long text, and of a slice of a batch.
PART_CHARS, SLICE_BYTES = 1 << 16, 1 << 20
#: Bytes of pieces whose token counts a task remembers.
MEMO_BYTES = 64 << 20
#: White space as the pattern's \s takes it (Unicode White_Space).
WHITE = r"\t-\r \x85\xa0  -     　"
_BETWEEN_WORDS = re.compile(r"(?<=[^\W_]) (?=[^\W_])")
#: A space that something other than white space follows, and two white characters; both take more for white than the pattern does.
_SAFE_SPACE = re.compile("[ ](?=[^\\s\u180e\u200b-\u200d\u2060\ufeff])")
_ONE_WHITE, _TWO_WHITE = (re.compile("[\\s\u180e\u200b-\u200d\u2060\ufeff]" + n) for n in ("", "{2}"))
#: How vocabulary files of this kind write a space at a token's start.
_SPACE_TOKEN = "\u0120"
_LONG_WHITE = re.compile(f"[{WHITE}]{{256,}}")


def safe_parts(text: str, size: int = PART_CHARS) -> list[str]:
    """text in parts of about size characters, cut before single spaces between words; joined they are the text."""
    out, start = [], 0
    while len(text) - start > size:
        m = _BETWEEN_WORDS.search(text, start + size)
        if m is None:
            break
        out.append(text[start : m.start()])
        start = m.start()
    return [*out, text[start:]]


def _library_counter(path: str):
    """Texts to token counts, by the library that the file is for."""
    if path.endswith(".json"):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task for each core
        t = Tokenizer.from_file(path)
        return lambda texts: [len(e) for e in t.encode_batch_fast(texts, add_special_tokens=False)]
    if path.endswith(".model"):
        from sentencepiece import SentencePieceProcessor

        p = SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in p.encode(texts, num_threads=1)]
    raise ValueError(f"neither a .json nor a .model file: {path}")


class _PieceCounter:
    """Token counts of texts as sums over the pieces that spaces begin; each distinct piece goes to the library once.

    A cut before a space is safe for the byte-level pattern unless white space stands on both sides: a match that holds
    the character before never goes on into the space, and a run of white space before it is a match of its own either
    way. Strings of special tokens hold no space, so no cut is inside one. Pieces without white space go to the library
    many in one text: tokens that begin with a space tell where each piece starts. What is remembered is bounded by bytes.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.count, self.known, self.held = _library_counter(path), {}, 0
        self.library = Tokenizer.from_file(path)
        vocabulary = self.library.get_vocab()
        self.opens = np.zeros(max(vocabulary.values()) + 1, bool)
        self.opens[[i for t, i in vocabulary.items() if t.startswith(_SPACE_TOKEN)]] = True

    def pieces(self, text: str) -> list[str]:
        """text cut before spaces; each piece but the first is without its space."""
        if _TWO_WHITE.search(text):
            return _SAFE_SPACE.split(text)
        return text.split(" ")

    def _learn(self, new: list[str]) -> None:
        plain = [w for w in new if w and not _ONE_WHITE.search(w)]
        alone = [w for w in new if not w or _ONE_WHITE.search(w)]
        for i in range(0, len(plain), 4096):
            part = plain[i : i + 4096]
            ids = np.array(self.library.encode_batch_fast([" " + " ".join(part)], add_special_tokens=False)[0].ids)
            start = np.flatnonzero(self.opens[ids])
            if len(start) == len(part):
                self.known.update(zip(part, np.diff(np.append(start, len(ids))).tolist()))
            else:
                alone += part
        for i in range(0, len(alone), 4096):
            self.known.update(zip(alone[i : i + 4096], self.count([" " + w for w in alone[i : i + 4096]])))
        self.held += sum(map(len, new)) + 100 * len(new)

    def __call__(self, texts: list[str]) -> list[int]:
        cut = [self.pieces(t) for t in texts]
        heads = self.count([c[0] for c in cut])
        if self.held > MEMO_BYTES:
            self.known, self.held = {}, 0
        self._learn([w for w in set().union(*(c[1:] for c in cut)) if w not in self.known])
        return [h + sum(map(self.known.__getitem__, c[1:])) for h, c in zip(heads, cut)]


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for every row of docs: id_col, n_bytes, n_tokens, over_limit (n_tokens > limit).

    Counts are those of the library for the vocabulary file, without begin, end or added special tokens; the string of
    a special token inside a text counts as the library takes it by default. Null texts are empty: 0 bytes, 0 tokens.
    A null id stays null; repeated rows each give a row; an empty table gives an empty result; other columns are not
    read. vocabulary: a path on every executor. Texts are cut only for vocabularies (.json) that have the byte-level
    pattern and special tokens without spaces; others count whole texts.
    """
    shared.small_batches(docs.sparkSession)
    schema = pa.schema([(id_col, pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])

    def run(batches):
        count = _PieceCounter(vocabulary) if _has_byte_pattern(vocabulary) else _library_counter(vocabulary)
        for batch in batches:
            _, offsets = shared.buffers(batch.column(1))
            tokens = np.zeros(batch.num_rows, np.int64)
            for a, b in shared.slices(offsets, SLICE_BYTES):
                tokens[a:b] = count(batch.column(1).slice(a, b - a).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(offsets)), pa.array(tokens), pa.array(tokens > limit)], schema=schema)

    return shared.texts(docs, id_col, text_col).mapInArrow(run, f"{_quoted(id_col)} long, n_bytes long, n_tokens long, over_limit boolean")


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _has_byte_pattern(path: str) -> bool:
    import json

    if not path.endswith(".json"):
        return False
    with open(path) as f:
        made = json.load(f)
    step = made.get("pre_tokenizer") or {}
    if any(" " in t["content"] or t["single_word"] or t["lstrip"] or t["rstrip"] for t in made.get("added_tokens") or []):
        return False
    return made.get("normalizer") is None and made.get("post_processor") is None and step.get("type") == "ByteLevel" and step.get("use_regex", True) and not step.get("add_prefix_space")


def encoding(ranks_path: str, pattern: str):
    """The encoding of a local rank file (a base64 token and its rank on each line)."""
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def encode_text(enc, text: str) -> list[int]:
    """Ids of a whole text: long runs of white space as the matches that the pattern makes of them, all else in safe parts."""
    out: list[int] = []
    start = 0
    for m in _LONG_WHITE.finditer(text) if len(text) > 256 else ():
        stop = m.end() if m.end() == len(text) else m.end() - 1
        for part in safe_parts(text[start : m.start()]):
            out += enc.encode_ordinary(part)
        out += enc._encode_single_piece(text[m.start() : stop])
        start = stop
    for part in safe_parts(text[start:]):
        out += enc.encode_ordinary(part)
    return out


def bpe_round_trip(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """One row for every row of docs: id_col, n_tokens, ids_sha256, decoded_sha256, n_bytes; with keep_ids also ids.

    Each match of the pattern is encoded apart by the ranks; no special tokens. ids_sha256 digests the ids as
    little-endian unsigned 32-bit integers, decoded_sha256 the bytes that decoding the ids gives. Null texts are empty
    (no ids; digests of nothing). A null id stays null; repeated rows each give a row; an empty table gives an empty
    result; other columns are not read. ranks_path: a path on every executor.
    """
    shared.small_batches(docs.sparkSession)
    fields = [(id_col, pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), ("n_bytes", pa.int64())]
    schema = pa.schema(fields + [("ids", pa.list_(pa.int64()))] * keep_ids)

    def run(batches):
        enc = encoding(ranks_path, pattern)
        for batch in batches:
            _, offsets = shared.buffers(batch.column(1))
            for a, b in shared.slices(offsets, SLICE_BYTES):
                rows = []
                for key, text in zip(batch.column(0).slice(a, b - a).to_pylist(), batch.column(1).slice(a, b - a).to_pylist()):
                    ids = encode_text(enc, text)
                    back = enc.decode_bytes(ids)
                    rows.append((key, len(ids), hashlib.sha256(np.asarray(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back).hexdigest(), len(back), *[ids] * keep_ids))
                yield shared.packed(rows, schema)

    return shared.texts(docs, id_col, text_col).mapInArrow(run, f"{_quoted(id_col)} long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_bytes long" + ", ids array<long>" * keep_ids)
