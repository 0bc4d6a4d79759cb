"""Asking a model by a table function: partitions bound what is asked at once, batches are made within them in order.

`ask_ordered` calls a Python UDTF on a table partitioned by the caller's key and sorted by its order; Spark brings the rows of a partition to one
call, one after another, so a batch is all that is held. Its schema comes from `analyze`, so any table with a prompt will do.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn

Ask = Callable[[list[str]], list[str | None]]


def ask_ordered(rows: DataFrame, partition: str, order: str, prompt: str, ask: Ask, size: int = 20, tries: int = 3) -> DataFrame:
    """(partition, order, batch, tried, status, answer) for each row of `rows`: `ask` gets up to `size` prompts of a partition, in order, at a time.

    A batch that raises, or answers with another number of answers, is tried `tries` times in all and then prompt by prompt, as often each; prompts without an answer are
    FAILED, the others keep theirs. tried counts the calls that a prompt was in; batch numbers a partition's batches from 0. Null prompts aren't asked and are FAILED. As many
    calls run at once as tasks do.
    """
    spark = rows.sparkSession

    class Asker:
        def __init__(self) -> None:
            self.held: list[tuple] = []
            self.batch = 0

        @staticmethod
        def analyze(table: AnalyzeArgument, key: AnalyzeArgument, by: AnalyzeArgument) -> AnalyzeResult:
            kinds = {f.name: f.dataType for f in table.dataType.fields}
            out = [StructField(key.value, kinds[key.value]), StructField(by.value, kinds[by.value]), StructField("batch", LongType()), StructField("tried", IntegerType()), StructField("status", StringType()), StructField("answer", StringType())]
            return AnalyzeResult(schema=StructType(out), partitionBy=[PartitioningColumn(key.value)], orderBy=[OrderingColumn(by.value)])

        def eval(self, row, key: str, by: str) -> Iterator[tuple]:
            self.held.append((row[key], row[by], row[prompt]))
            if len(self.held) == size:
                yield from self._answers()

        def terminate(self) -> Iterator[tuple]:
            if self.held:
                yield from self._answers()

        def _call(self, prompts: list[str]) -> tuple[list[str | None] | None, int]:
            for k in range(tries):
                try:
                    found = list(ask(prompts))
                    if len(found) == len(prompts):
                        return found, k + 1
                except Exception:  # noqa: BLE001
                    pass
            return None, tries

        def _answers(self) -> Iterator[tuple]:
            asked = [x[2] for x in self.held if x[2] is not None]
            found, tried = self._call(asked) if asked else ([], 0)
            each = iter([(a, tried) for a in found] if found is not None else [((a or [None])[0], tried + n) for a, n in map(lambda p: self._call([p]), asked)])
            for key, by, text in self.held:
                answer, n = next(each) if text is not None else (None, 0)
                yield key, by, self.batch, n, "FAILED" if answer is None else "SUCCESS", answer
            self.held, self.batch = [], self.batch + 1

    name = f"gleaner_ask_{uuid.uuid4().hex}"
    spark.udtf.register(name, F.udtf(Asker))
    return spark.sql(f"SELECT * FROM {name}(TABLE({{rows}}), :key, :by)", args={"key": partition, "by": order}, rows=rows.select(partition, order, prompt))
