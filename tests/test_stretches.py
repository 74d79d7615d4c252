"""A batch is worked on in stretches."""

from __future__ import annotations

import pyarrow as pa

from attestry.functions import crypto


def test_no_more_rows_are_objects_at_once_than_a_stretch():
    seen = []

    def many(rows):
        seen.append(len(rows))
        return [x + x for x in rows]

    n = 2 * crypto.STRETCH + 60
    given = pa.array([None if k == 5 else str(k).encode() for k in range(n)], pa.binary())
    told = crypto._batch(pa.binary(), lambda x: x + x, many, lambda x: True, given).to_pylist()
    assert told == [None if k == 5 else str(k).encode() * 2 for k in range(n)]
    assert max(seen) <= crypto.STRETCH
    assert crypto._batch(pa.binary(), None, many, None, given.slice(0, 0)).to_pylist() == []
