"""BPE encoding and decoding through a table of distinct words.

Blocks of texts are cut into words as the tokenizer would, and each block sends every word it holds once
to a bucket by hash. A bucket encodes each distinct word once for the whole corpus and answers every block
with the ids. Blocks meet their answers again by block key, and ids are put back by word position. Decoding
joins ids to vocabulary pieces; that table is as large as the vocabulary, whatever the corpus.

A block's key is a hash of its rows in order. Should a retried scan cut blocks otherwise, the words of a
block without an answer are encoded where they are, so results do not depend on how blocks are cut.

For tokenizer files with a normalizer, a split pattern applied with inverted "removed" behaviour, byte-level
letters and BPE, without decoder and post-processor; other files are refused. Special tokens in a text are
taken as the file says.

Defined cases: a null or empty text has no ids and decodes to an empty text; a null id is carried; repeated
rows are encoded each; an empty table gives an empty result. Other columns play no part.
"""

from __future__ import annotations

import json
import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeworks.llm import blocks as B

# Words of a block that are held as Python strings.
HELD_WORDS = 50_000
ENCODED = "id long, n_tokens long, ids binary, decoded string"


def _latin_class(kind: str) -> str:
    """The characters below U+0100 of a general category, for use inside brackets."""
    return "".join(re.escape(chr(c)) for c in range(256) if unicodedata.category(chr(c)).startswith(kind))


# White space below U+0100.
_SPACES = "\\t-\\r \\x85\\xa0"


class WordEncoder:
    """Words of a text and ids of a word, by the installed library and the tokenizer file's own rules."""

    def __init__(self, content: str):
        import os

        from tokenizers import Regex, Tokenizer, pre_tokenizers

        # Tasks have a core each.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"

        rules = json.loads(content)
        steps = (rules["pre_tokenizer"] or {}).get("pretokenizers") or [{}]
        if rules["decoder"] or rules["post_processor"] or rules["model"]["type"] != "BPE" or [s.get("type") for s in steps] != ["Split", "ByteLevel"] or not steps[0]["invert"]:
            raise ValueError("this tokenizer file needs rules that are not supported")
        # One vocabulary a task: the words' tokenizer is the file's without its first two steps.
        self.word = Tokenizer.from_str(content)
        self.normalise = self.word.normalizer.normalize_str
        self.split = pre_tokenizers.Split(Regex(steps[0]["pattern"]["Regex"]), "removed", invert=True).pre_tokenize_str
        pattern = steps[0]["pattern"]["Regex"]
        for name, letters in (("\\p{L}", _latin_class("L")), ("\\p{N}", _latin_class("N")), ("\\s", _SPACES)):
            pattern = pattern.replace(name, letters)
        self.find = re.compile(pattern).findall
        self.special = {t.content: i for i, t in self.word.get_added_tokens_decoder().items()}
        self.specials = re.compile("(" + "|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.size = self.word.get_vocab_size()
        self.piece = self.word.id_to_token
        self.word.normalizer = None
        self.word.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)

    def _plain(self, text: str) -> list[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return [word for word, _ in self.split(self.normalise(text))]
        # Below U+0100 nothing is composed, and letters have one lower case each.
        return self.find(text.lower())

    def words(self, text: str) -> list[str]:
        if self.specials is None or not self.specials.search(text):
            return self._plain(text)
        out: list[str] = []
        for piece in self.specials.split(text):
            out += [piece] if piece in self.special else self._plain(piece)
        return out

    def ids(self, words: list[str]) -> pa.Array:
        """Lists of ids of distinct words."""
        kind = pa.uint16() if self.size <= 1 << 16 else pa.uint32()
        found = [pa.array([], pa.list_(kind))]
        for at in range(0, len(words), 20_000):
            part = words[at:at + 20_000]
            ids = [[self.special[w]] if w in self.special else e.ids for w, e in zip(part, self.word.encode_batch_fast(part, add_special_tokens=False), strict=True)]
            found.append(pa.array(ids, pa.list_(kind)))
        return pa.concat_arrays(found)

    def pieces(self) -> pa.Array:
        """Every id's piece and a space."""
        return pa.array([(self.piece(i) or "") + " " for i in range(self.size)], pa.large_string())


def _once(content: str):
    """The encoder, made when a task first asks for it."""
    made: list[WordEncoder] = []

    def get() -> WordEncoder:
        if not made:
            made.append(WordEncoder(content))
        return made[0]

    return get


def _distinct(rules: WordEncoder, texts: list[str]) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words of a block as places in its list of distinct words, where each text's begin, and that list."""
    found, first, parts = [], [0], []
    for text in texts:
        words = rules.words(text)
        first.append(first[-1] + len(words))
        found += words
        # Words as Python strings take many times their letters.
        if len(found) > HELD_WORDS:
            parts.append(pa.array(found, pa.large_string()))
            found = []
    table = pa.concat_arrays([*parts, pa.array(found, pa.large_string())]).dictionary_encode()
    return np.asarray(table.indices), np.array(first), table.dictionary


def _by_bucket(words: pa.Array, buckets: int) -> list[tuple[int, np.ndarray]]:
    data, offsets = B.buffer(words)
    return list(B.split((B.word_hashes(data, offsets[:-1], offsets[1:]) % np.uint64(buckets)).astype(np.int64)))


def _block_key(block: pa.RecordBatch) -> int:
    import xxhash

    keys = B.row_keys(np.asarray(block.column("id").fill_null(0)), block.column("text"))
    return xxhash.xxh3_64_intdigest(keys.tobytes()) >> 1


def _words_to_buckets(rules_of, buckets: int):
    def run(batches):
        rules = rules_of()
        for block in B.blocks(batches):
            _, _, words = _distinct(rules, block.column("text").to_pylist())
            key = _block_key(block)
            rows = [(number, key, B.pack({"word": words.take(pa.array(part))})) for number, part in _by_bucket(words, buckets)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [[]] * 3, (pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["bucket", "block", "blob"])

    return run


def _bucket_answers(rules_of):
    def run(key, table):
        B.release()
        lists = [B.unpack(x).column("word") for x in table.column("blob")]
        coded = pa.concat_arrays(lists).dictionary_encode()
        ids = rules_of().ids(coded.dictionary.to_pylist())
        rows, at = [], 0
        for block, words in zip(table.column("block").to_pylist(), lists, strict=True):
            rows.append((block, key[0].as_py(), B.pack({"ids": ids.take(coded.indices.slice(at, len(words)))})))
            at += len(words)
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["block", "bucket", "blob"])

    return run


def _blocks_kept(batches):
    for block in B.blocks(batches):
        blob = B.pack({"id": block.column("id"), "text": block.column("text")})
        yield pa.RecordBatch.from_arrays([pa.array([_block_key(block)], pa.int64()), pa.array([blob], pa.binary())], names=["block", "blob"])


def _joined(rules_of, buckets: int):
    def run(texts, answers):
        B.release()
        rules = rules_of()
        told = dict(zip(answers.column("bucket").to_pylist(), answers.column("blob"), strict=True))
        pieces = rules.pieces()
        out = []
        for blob in texts.column("blob"):
            block = B.unpack(blob)
            places, first, words = _distinct(rules, block.column("text").to_pylist())
            lists, order = [], []
            for number, part in _by_bucket(words, buckets):
                ids = B.unpack(told[number]).column("ids") if number in told else None
                lists.append(ids if ids is not None and len(ids) == len(part) else rules.ids(words.take(pa.array(part)).to_pylist()))
                order.append(part)
            if lists:
                back = np.empty(len(words), np.int64)
                back[np.concatenate(order)] = np.arange(len(words))
                tokens = pa.concat_arrays(lists).take(pa.array(back[places]))
                ends = np.concatenate(([0], np.cumsum(np.asarray(tokens.value_lengths()))))[first]
                ids = np.asarray(tokens.flatten())
            else:
                ends, ids = np.zeros(len(first), np.int64), np.zeros(0, np.uint16)
            data, offsets = B.buffer(pieces.take(pa.array(ids)))
            raw, text = ids.astype("<u4").tobytes(), data.tobytes()
            spans = list(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True))
            out.append(pa.table({
                "id": block.column("id"),
                "n_tokens": pa.array(np.diff(ends), pa.int64()),
                "ids": pa.array([raw[4 * a:4 * b] for a, b in spans], pa.binary()),
                # Pieces are joined by a space; the last one's is cut off.
                "decoded": pa.array([text[offsets[a]:max(offsets[a], offsets[b] - 1)].decode() for a, b in spans], pa.string()),
            }))
        return pa.concat_tables(out) if out else pa.table({"id": pa.array([], pa.int64()), "n_tokens": pa.array([], pa.int64()), "ids": pa.array([], pa.binary()), "decoded": pa.array([], pa.string())})

    return run


def encode(docs: DataFrame, tokenizer: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``id``, ``n_tokens``, ``ids`` (unsigned 32-bit, little-endian) and ``decoded`` of every row.

    ``tokenizer`` is the path of a tokenizer file that the driver can read.
    """
    with open(tokenizer, encoding="utf-8") as file:
        content = file.read()
    WordEncoder(content)
    slim = docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text"))
    buckets = B.parts(docs, B.text_bytes(slim), B.BUCKET_BYTES)
    answers = (
        slim.mapInArrow(_words_to_buckets(_once(content), buckets), "bucket long, block long, blob binary")
        .groupBy("bucket").applyInArrow(_bucket_answers(_once(content)), "block long, bucket long, blob binary")
    )
    kept = slim.mapInArrow(_blocks_kept, "block long, blob binary")
    return kept.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_joined(_once(content), buckets), ENCODED)


def decode(encoded: DataFrame, tokenizer: str, ids: str = "ids") -> DataFrame:
    """``encoded`` with a column ``decoded`` from a column of packed ids; null ids decode to null.

    Distinct id sequences become rows of position and id, which are joined with the vocabulary's id-to-piece table, broadcast as
    it has a fixed size, and put together by position. A column of that name is replaced. Ids outside the vocabulary are left out.
    """
    with open(tokenizer, encoding="utf-8") as file:
        rules = WordEncoder(file.read())
    spark = encoded.sparkSession
    pieces = F.broadcast(spark.createDataFrame([(i, rules.piece(i) or "") for i in range(rules.size)], "_id long, _piece string"))
    packed = F.col("`" + ids.replace("`", "``") + "`")
    key = F.sha2(packed, 256)
    distinct = encoded.where(packed.isNotNull()).groupBy(key.alias("_key")).agg(F.first(packed).alias("_ids"))
    # Four bytes an id, the lowest first.
    byte = lambda at: F.hex(F.substring("_ids", at, F.lit(1)))
    number = lambda i: F.conv(F.concat(*[byte(i * 4 + F.lit(b)) for b in (4, 3, 2, 1)]), 16, 10).cast("long")
    count = F.floor(F.octet_length("_ids") / 4).cast("int")
    places = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
    tokens = distinct.select("_key", F.posexplode_outer(F.transform(places, number)).alias("_at", "_id"))
    found = tokens.join(pieces, "_id", "left").groupBy("_key").agg(F.array_sort(F.collect_list(F.when(F.col("_piece").isNotNull(), F.struct("_at", "_piece")))).alias("_all"))
    texts = found.select("_key", F.array_join(F.transform("_all", lambda x: x["_piece"]), " ").alias("_text"))
    names = [c for c in encoded.columns if c != "decoded"]
    return encoded.join(texts, key == F.col("_key"), "left").select(*[F.col("`" + c.replace("`", "``") + "`") for c in names], F.col("_text").alias("decoded"))
