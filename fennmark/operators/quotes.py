"""Which texts hold which quotes: one automaton for many quotes passes once over each text.

Quotes are taken in blocks of bounded size. A block's automaton is sent to the tasks that scan the texts, and every text is read once a block, from its first character to its last, whatever the number
of quotes. Nothing of a text is shuffled; what comes out is a row for each quote that it holds.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..stored import stored

#: Quotes of a block, and their characters, at most: some 100 bytes of automaton for each character.
BLOCK_ROWS, BLOCK_CHARS = 50_000, 1_000_000


def _blocks(quotes: DataFrame) -> Iterator[list[str]]:
    held, size = [], 0
    for row in quotes.select("form").toLocalIterator():
        if held and (len(held) >= BLOCK_ROWS or size + len(row.form) > BLOCK_CHARS):
            yield held
            held, size = [], 0
        held.append(row.form)
        size += len(row.form)
    if held:
        yield held


def _scanned(texts: DataFrame, forms: list[str]) -> DataFrame:
    """doc, form of the forms of a block that texts (doc, form) hold."""
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for k, form in enumerate(forms):
        automaton.add_word(form, k)
    automaton.make_automaton()
    shared = texts.sparkSession.sparkContext.broadcast(automaton)
    doc = texts.schema["doc"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found_in = shared.value
        for batch in batches:
            docs, found = [], []
            for k, text in enumerate(batch.column(1).to_pylist()):
                hits = sorted({number for _, number in found_in.iter(text)}) if text else []
                docs += [k] * len(hits)
                found += [forms[h] for h in hits]
            if docs:
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(docs)), pa.array(found, pa.string())], names=["doc", "form"])

    return texts.select("doc", "form").mapInArrow(run, f"doc {doc}, form string")


def held(quotes: DataFrame, texts: DataFrame) -> DataFrame:
    """quote, doc: each quote (quote, form) and each text (doc, form) that holds its form as it is. An empty form is held by nothing. Equal forms are looked for once."""
    forms = stored(quotes.where("form <> ''").select("form").distinct(), "forms")
    parts = [stored(_scanned(texts, block), "held") for block in _blocks(forms)]
    if not parts:
        return quotes.select("quote").limit(0).crossJoin(texts.select("doc").limit(0))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return quotes.select("quote", "form").join(out, "form").select("quote", "doc").distinct()
