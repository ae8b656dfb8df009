import numpy as np

from graphloom.llm import decontam


def test_short_items_are_found_word_for_word():
    space = np.eye(decontam.DIM, decontam.RANK, dtype=np.float32)
    rows = [(0, "Who wrote it?"), (1, "zebra"), (2, "one two three four five six seven"), (3, ""), (4, "who wrote it"), (5, "one two three four five six seven eight")]
    items = decontam.Items.build([{"item_id": i, "text": t} for i, t in rows], space)
    texts = ["a b who WROTE it, c who wrote it", "who wrote", "it zebra", None, "x who wrote of it", "one two three four five six seven", "", "zebras"]
    got = sorted((t, items.ids[j], at, lcs) for t, j, at, _, lcs, _ in items.find(texts) if items.ids[j] != 5)
    assert got == [(0, 0, 2, 1.0), (0, 4, 2, 1.0), (2, 1, 1, 1.0), (5, 2, 0, 1.0)]
    only = decontam.Items.build([{"item_id": 1, "text": "zebra"}], space)
    assert [h[:3] for h in only.find(texts)] == [(2, 0, 1)]
