"""Places where a user plugs in models: embedders, answer writers, judges, loaders.

Each hook is a batch function that Spark calls on Arrow batches inside tasks.
"""

from __future__ import annotations

import dataclasses
import functools
import inspect
import queue
import threading
from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_EMBEDDERS: dict[str, Callable] = {}
_WRITERS: dict[str, Callable] = {}
_CHATS: dict[str, Callable] = {}
_JUDGES: dict[str, Callable] = {}


def register_embedder(provider: str, make_predict: Callable) -> None:
    """``make_predict(model)`` loads the model of that name in the task; it maps texts to a matrix.

    A function without parameters stands for a provider with one model.
    """
    _EMBEDDERS[provider] = make_predict


@dataclasses.dataclass(frozen=True)
class ChatOptions:
    """What a model client is made with, and how its calls are bounded."""

    model: str | None = None
    temperature: float = 0.0
    max_tokens: int = 1024
    # Prompts in flight in a task, seconds that one call may take, and calls per prompt.
    in_flight: int = 8
    timeout: float = 60.0
    attempts: int = 3


def register_writer(provider: str, write: Callable[..., pd.Series]) -> None:
    """``write(system, human)`` or ``write(system, human, options)`` maps a batch of prompts to answers."""
    _WRITERS[provider] = write


def register_chat(provider: str, make_ask: Callable[[ChatOptions], Callable[[str, str], str]]) -> None:
    """``make_ask(options)`` makes a client in the task; it maps one ``system, human`` to an answer.

    For models that take one prompt a call: several are in flight at once.
    """
    _CHATS[provider] = make_ask


def register_judge(provider: str, judge: Callable) -> None:
    """``judge(claim, context)`` maps a batch to booleans."""
    _JUDGES[provider] = judge


def _lookup(table: dict, kind: str, provider: str):
    if provider not in table:
        raise ValueError(f"Unknown {kind} provider: '{provider}'. Known: {sorted(table)}")
    return table[provider]


def embedder(
    provider: str, text: str = "text", batch_size: int = 256, model: str | None = None
) -> Callable[[DataFrame], DataFrame]:
    """A function that adds ``embedding`` to a table of texts."""
    make_predict = _lookup(_EMBEDDERS, "embedding", provider)
    if inspect.signature(make_predict).parameters:
        make_predict = functools.partial(make_predict, model)
    predict = predict_batch_udf(
        make_predict,
        return_type=T.ArrayType(T.FloatType()),
        batch_size=batch_size,
    )
    return lambda texts: texts.withColumn("embedding", predict(F.col(text)))


class Calls:
    """Calls of one task: at most ``in_flight`` at a time, answers in the order of the prompts.

    A call that raises is repeated, one beyond its time is given up; its thread may still wait
    for the other side, so it is a daemon and a new one takes its place.
    """

    def __init__(self, ask: Callable[[str, str], str], options: ChatOptions):
        self.ask, self.options = ask, options
        self.todo: queue.SimpleQueue = queue.SimpleQueue()
        self.workers = 0

    def start(self, system: str, human: str) -> dict:
        call = {"prompt": (system, human), "begun": threading.Event(), "done": threading.Event(), "answer": None, "error": None}
        if self.workers < self.options.in_flight:
            self.workers += 1
            threading.Thread(target=self._work, daemon=True).start()
        self.todo.put(call)
        return call

    def result(self, call: dict) -> tuple[str | None, str | None]:
        """``(answer, error)``; waits as long as all attempts may take from when the call began."""
        call["begun"].wait()
        if not call["done"].wait(self.options.timeout * self.options.attempts):
            # The worker is lost with its call; another takes what waits behind it.
            call["lost"] = True
            threading.Thread(target=self._work, daemon=True).start()
            return None, "timeout"
        return call["answer"], call["error"]

    def _work(self) -> None:
        while (call := self.todo.get()) is not None:
            call["begun"].set()
            for _ in range(self.options.attempts):
                if call.get("lost"):
                    return
                try:
                    call["answer"], call["error"] = self.ask(*call["prompt"]), None
                    break
                except Exception as error:  # noqa: BLE001 - whatever a client raises is the row's error
                    call["error"] = f"{type(error).__name__}: {error}"
            call["done"].set()
            if call.get("lost"):
                return

    def close(self) -> None:
        for _ in range(self.workers):
            self.todo.put(None)


def chat_writer(make_ask: Callable, options: ChatOptions) -> Callable[[DataFrame], DataFrame]:
    """A function that adds ``answer`` and ``error``, one of them null, to a table of prompts."""

    def answer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        calls = Calls(make_ask(options), options)
        try:
            for batch in batches:
                waiting: deque = deque()
                told = []
                for system, human in zip(batch["system"], batch["human"]):
                    if len(waiting) >= options.in_flight:
                        told.append(calls.result(waiting.popleft()))
                    waiting.append(calls.start(system, human))
                told += [calls.result(call) for call in waiting]
                yield batch.assign(answer=[a for a, _ in told], error=[e for _, e in told])
        finally:
            calls.close()

    fields = [T.StructField("answer", T.StringType()), T.StructField("error", T.StringType())]
    return lambda prompts: prompts.mapInPandas(answer, T.StructType([*prompts.schema.fields, *fields]))


def writer(provider: str, options: ChatOptions = ChatOptions()) -> Callable[[DataFrame], DataFrame]:
    """A function that adds ``answer`` to a table with ``system`` and ``human``; a chat adds ``error`` too."""
    if provider in _CHATS:
        return chat_writer(_CHATS[provider], options)
    write = _lookup(_WRITERS, "LLM", provider)
    if len(inspect.signature(write).parameters) > 2:
        write = functools.partial(_with_options, write, options)

    def run(prompts: DataFrame) -> DataFrame:
        def answer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                yield batch.assign(answer=write(batch["system"], batch["human"]))

        return prompts.mapInPandas(
            answer, T.StructType([*prompts.schema.fields, T.StructField("answer", T.StringType())])
        )

    return run


def _with_options(write: Callable, options: ChatOptions, system: pd.Series, human: pd.Series) -> pd.Series:
    return write(system, human, options)


def judge(provider: str):
    """A column function ``(claim, context) -> boolean``."""
    return F.pandas_udf(_lookup(_JUDGES, "judge", provider), T.BooleanType())
