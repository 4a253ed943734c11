import pyarrow as pa

from loomline.llm import common, toxicity


class Frame:
    def mapInArrow(self, run, schema):
        return run


def test_a_task_leaves_no_words_behind():
    """Caches serve all batches of a task; the worker, which goes on to other stages, keeps none."""
    full = []

    def fn(b):
        for t in b.column(0).to_pylist():
            common.shingle_set(t), toxicity.word_set(t)
        full.append((len(common._hashes), len(toxicity._features)))
        return b

    run = common.arrow_map(Frame(), fn, "text string")
    texts = pa.array([f"word{chr(97 + i % 26)} other{chr(97 + i // 26)} three" for i in range(600)])
    assert sum(b.num_rows for b in run(iter([pa.RecordBatch.from_arrays([texts], names=["text"])]))) == 600
    assert len(full) == 3 and full[0] < full[-1]
    assert not common._hashes and not toxicity._features
