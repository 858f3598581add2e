"""Windows of many short texts leave a task in few batches."""

import numpy as np
import pyarrow as pa

from broadsheet.llm import repeats, suffixes


def test_windows_of_many_texts_come_in_one_batch():
    texts = [bytes([65 + i % 7]) * 120 for i in range(50)]
    kind = pa.list_(pa.struct([("low", pa.int32()), ("high", pa.int32()), ("weight", pa.int32())]))
    probe = pa.array([[{"low": 0, "high": 2, "weight": 1}, {"low": 5, "high": 5, "weight": 2}]] * 50, kind)
    rows = pa.RecordBatch.from_arrays([pa.array(range(50), pa.int64()), pa.array(texts, pa.binary()), probe], ["at", "text", "probes"])
    made = list(repeats._spelled_out(iter([rows, rows.slice(10, 5)]), suffixes.byte_symbols, 100))
    assert len(made) == 1 and made[0].num_rows == 4 * 55
    found = made[0].to_pandas()
    assert found["start"].tolist() == [0, 1, 2, 5] * 55 and found["weight"].tolist() == [1, 1, 1, 2] * 55
    assert found["at"].tolist() == np.repeat([*range(50), *range(10, 15)], 4).tolist()
    assert found.groupby(found["at"] % 7)["w1"].nunique().tolist() == [1] * 7 and found["w2"].nunique() == 7
