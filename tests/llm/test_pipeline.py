"""The whole pipeline on the smallest tables: what its stages keep is held against plain checks."""

import re

import corpus_pipeline
from callsight.llm import rules
from callsight.llm.common import settle, table


def shingles(text):
    words = text.encode().lower().split()
    return {tuple(words[at : at + 5]) for at in range(max(1, len(words) - 4))}


def test_stages_keep_what_they_should(spark, sf):
    documents = table(spark, sf, "documents")
    docs, kept = documents, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = settle(stage(spark, docs, sf))
        assert docs.columns == documents.columns, name
        kept[name] = {row.doc_id: row.text for row in docs.select("doc_id", "text").collect()}
    order = [set(documents.toPandas().doc_id), *(set(rows) for rows in kept.values())]
    assert all(later <= earlier for earlier, later in zip(order, order[1:]))
    judged = {row.doc_id: row.kept for row in rules.query(spark, sf).collect()}
    assert set(kept["quality_rules"]) == {doc for doc in kept["quality_classifier"] if judged[doc]}
    lines = kept["line_templates"]
    assert all(set(lines[doc].split("\n")) <= set((kept["quality_rules"][doc] or "").split("\n")) for doc in lines)
    before = {doc: shingles(text) for doc, text in lines.items() if re.search(r"[^\x20\x09-\x0D]", text or "")}
    near = lambda a, b: len(a & b) * 100 >= 80 * len(a | b)
    stay = [doc for doc in kept["near_duplicates"] if doc in before]
    assert all(not near(before[a], before[b]) for at, a in enumerate(stay) for b in stay[:at])
    gone = set(before) - set(stay)
    linked = {doc: {other for other in before if other != doc and near(before[doc], before[other])} for doc in before}
    for doc in gone:  # each that left is in a component of which one stays
        seen, waiting = {doc}, [doc]
        while waiting:
            for other in linked[waiting.pop()] - seen:
                seen.add(other)
                waiting.append(other)
        assert len(seen & set(stay)) == 1
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    assert {row.doc_id for row in packed} == set(kept["near_duplicates"])
    room: dict[int, list] = {}
    for row in packed:
        room.setdefault(row.sequence_id, []).append((row.offset, row.length))
    for pieces in room.values():
        pieces.sort()
        assert pieces[0][0] == 0 and sum(length for _, length in pieces) <= 2048
        assert all(a + length == b for (a, length), (b, _) in zip(pieces, pieces[1:]))
