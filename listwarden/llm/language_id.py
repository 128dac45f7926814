"""Language identification by compression.

For every language, texts of that language serve as a zstandard raw-content dictionary. A text is
compressed with each dictionary; it is in the language whose dictionary makes it smallest. Texts and
dictionaries are lower case with every run of other characters than letters made one blank. Long
texts are compressed in pieces of PIECE bytes, each with the dictionary alone, and the sizes are
added: so the dictionary counts for the whole text.

The score is the margin between the two smallest sizes, as a share of the smallest, scaled so that
a margin of FULL_MARGIN or more gives 1. Narrow margins are rejected: texts in a language without
dictionary, and junk, compress about equally with all dictionaries.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listwarden.llm.words import slices

#: Bytes of sample texts for the dictionary of one language, and of each text in it.
DICTIONARY_BYTES, SAMPLE_BYTES = 112_000, 128
PIECE, LEVEL = 4_096, 5
#: NARROW_MARGIN was chosen on sf0.1: of 2,500 labelled documents that are not held out, 7 of the 2,481
#: told right lie below it, and 95 % or more of each language left out of learning (README).
FULL_MARGIN, NARROW_MARGIN = 0.25, 0.05
UNKNOWN = "und"


_NO_LETTERS = regex.compile(r"\P{L}+")


def letters(text: str) -> bytes:
    return _NO_LETTERS.sub(" ", text.lower()).strip().encode()


def learn(labelled: DataFrame) -> dict[str, bytes]:
    """Dictionaries from rows of text and lang; rows where either is null or text is empty are skipped.

    A bounded sample is enough for a dictionary: per language, the texts of the smallest hashes,
    from each of them SAMPLE_BYTES of its letters from a place that the hash gives, at most
    DICTIONARY_BYTES in all. Small samples of many texts keep a passage that texts of several
    languages share from filling a dictionary. Equal texts count once. Without rows the result is
    empty, and every prediction is `und`.
    """
    hashed = labelled.select("lang", "text", F.xxhash64("text").alias("hash")).filter("lang IS NOT NULL AND trim(text) <> ''")
    need = 4 * DICTIONARY_BYTES // SAMPLE_BYTES  # short texts fill little
    shares = {r.lang: min(1.0, need / r["count"]) for r in hashed.groupBy("lang").count().collect()}  # a row per language
    if not shares:
        return {}
    share = F.create_map(*[F.lit(x) for pair in shares.items() for x in pair])[F.col("lang")]
    start = F.pmod(F.shiftright("hash", 20), F.greatest(F.length("text") - 2 * SAMPLE_BYTES, F.lit(1))) + 1
    # the lowest part of the hash range: about `need` rows of each language, however many there are
    near = hashed.filter(F.pmod("hash", F.lit(1 << 20)) < share * (1 << 20)).select(
        "lang", "hash", F.substr("text", start.cast("int"), F.lit(2 * SAMPLE_BYTES)).alias("piece")
    ).dropDuplicates(["lang", "hash"])
    out: dict[str, bytes] = {lang: b"" for lang in shares}
    for row in near.orderBy("lang", F.pmod("hash", F.lit(1 << 20)), "hash").collect():
        if len(out[row.lang]) < DICTIONARY_BYTES:
            out[row.lang] += letters(row.piece)[:SAMPLE_BYTES] + b" "
    return {lang: content for lang, content in out.items() if content.strip()}


def _sizes(data: bytes, compressors: list[zstandard.ZstdCompressor]) -> list[int]:
    pieces = [data[i : i + PIECE] for i in range(0, len(data), PIECE)]
    return [sum(len(c.compress(p)) for p in pieces) for c in compressors]


def predict(docs: DataFrame, dictionaries: dict[str, bytes], text: str = "text", keep_text: bool = True) -> DataFrame:
    """docs with columns lang_pred, score and rejected; columns of these names are replaced.

    `und`, score 0 and rejected if text is null or has no letter. Ties go to the language that
    sorts first. With one language only, its margin counts as full. Rows stay as they are, without
    the text unless keep_text: then it need not come back from Python.
    """
    names = sorted(dictionaries)
    kept = [c for c in docs.columns if c not in ("lang_pred", "score", "rejected", *([] if keep_text else [text]))]
    sent = kept if text in kept else [*kept, text]
    place = sent.index(text)

    def judged(data: bytes, makers: list[zstandard.ZstdCompressor]) -> tuple[str, float]:
        if not names or not data:
            return UNKNOWN, 0.0
        sizes = _sizes(data, makers)
        order = sorted(range(len(names)), key=sizes.__getitem__)
        margin = (sizes[order[1]] - sizes[order[0]]) / sizes[order[0]] if len(names) > 1 else FULL_MARGIN
        return names[order[0]], min(1.0, margin / FULL_MARGIN)

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        makers = []
        for name in names:
            content = zstandard.ZstdCompressionDict(dictionaries[name], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            content.precompute_compress(level=LEVEL)
            makers.append(zstandard.ZstdCompressor(dict_data=content, write_content_size=False, write_dict_id=False))
        for batch in parts:
            for part in slices(batch, place):
                found = [judged(letters(value.as_py() or ""), makers) for value in part.column(place)]
                preds, scores = zip(*found, strict=True) if found else ((), ())
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[: len(kept)], pa.array(preds, pa.string()), pa.array(scores, pa.float64())],
                    names=[*part.schema.names[: len(kept)], "lang_pred", "score"])

    source = docs.select(*[F.col(f"`{c}`") for c in sent])
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in source.schema[: len(kept)])
    out = source.mapInArrow(batches, f"{schema}lang_pred string, score double")
    return out.withColumn("rejected", F.col("score") < NARROW_MARGIN / FULL_MARGIN)


def held_out(doc_id: Column) -> Column:
    """Every third document by checksum of its id; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def keep_known(docs: DataFrame, dictionaries: dict[str, bytes]) -> DataFrame:
    """The rows of docs whose language is told with a clear margin, with the columns of docs."""
    names = docs.columns
    numbered = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])
    known = predict(numbered, dictionaries, f"c{names.index('text')}").filter(~F.col("rejected"))
    return known.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)])
