"""What lies outside the engine: language models and speech engines, as functions that are passed in.

Every analysis before and after them is deterministic; with the stubs here the whole of it is.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame

from . import runtime


class Model(Protocol):
    def __call__(self, prompt: str, task: str) -> str: ...


class Transcriber(Protocol):
    def __call__(self, audio: bytes, language: str | None) -> str: ...


def echo(prompt: str, task: str) -> str:
    """A model that answers with its task and the size of its prompt."""
    return f"{task}: {len(prompt)}"


@dataclass
class Scripted:
    """A model with an answer for each task."""

    answers: dict[str, str]

    def __call__(self, prompt: str, task: str) -> str:
        return self.answers.get(task, "")


def answer_all(prompts: DataFrame, model: Model, parallel: int = 4) -> DataFrame:
    """(id, task, prompt) with each answer; at most ``parallel`` calls at a time, as providers set quotas.

    The model runs late in the plan, over rows already chosen; a failure gives its text in ``error``.
    """

    def ask(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            rows = []
            for i, task, prompt in zip(p.id, p.task, p.prompt, strict=True):
                try:
                    rows.append((i, task, model(prompt, task), None))
                except Exception as e:
                    rows.append((i, task, None, str(e)[:300]))
            yield pd.DataFrame(rows, columns=["id", "task", "answer", "error"])

    runtime.ship(prompts.sparkSession)
    return prompts.select("id", "task", "prompt").repartition(parallel, "id").mapInPandas(ask, "id string, task string, answer string, error string")


def transcribe_all(chunks: DataFrame, engine: Transcriber, known: DataFrame | None = None, parallel: int = 4, attempts: int = 3) -> DataFrame:
    """(recording_id, idx, payload) to (recording_id, idx, text, gap): pieces already known are not sent again.

    A piece that fails every attempt becomes a gap; the others go on.
    """
    todo = chunks.join(known.select("recording_id", "idx"), ["recording_id", "idx"], "leftanti") if known is not None else chunks

    def hear(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            rows = []
            for r, i, payload in zip(p.recording_id, p.idx, p.payload, strict=True):
                text: str | None = None
                for _ in range(attempts):
                    try:
                        text = engine(payload, None)
                        break
                    except Exception:  # the engine's own errors are the connector's to tell apart
                        continue
                rows.append((r, i, text if text is not None else "[00:00] (missing)", text is None))
            yield pd.DataFrame(rows, columns=["recording_id", "idx", "text", "gap"])

    runtime.ship(chunks.sparkSession)
    out = todo.select("recording_id", "idx", "payload").repartition(parallel).mapInPandas(hear, "recording_id string, idx int, text string, gap boolean")
    return out.unionByName(known.select("recording_id", "idx", "text", "gap")) if known is not None else out


class ThinkFilter:
    """Takes <think> parts out of a stream of tokens, wherever the tags are cut."""

    def __init__(self) -> None:
        self.held, self.inside = "", False

    def feed(self, token: str) -> str:
        self.held += token
        out = ""
        while True:
            tag = "</think>" if self.inside else "<think>"
            at = self.held.find(tag)
            if at >= 0:
                out += "" if self.inside else self.held[:at]
                self.held, self.inside = self.held[at + len(tag) :], not self.inside
                continue
            keep = next((n for n in range(min(len(tag) - 1, len(self.held)), 0, -1) if tag.startswith(self.held[-n:])), 0)
            out += "" if self.inside else self.held[: len(self.held) - keep]
            self.held = self.held[len(self.held) - keep :] if keep else ""
            return out

    def close(self) -> str:
        out, self.held = ("" if self.inside else self.held), ""
        return out


def streamed(tokens: Iterator[str | None], clock: Callable[[], float] = time.monotonic, quiet: float = 15.0) -> Iterator[tuple[str, str]]:
    """What a reader of a model's answer sees: ('delta', text) as it comes, then ('done', all of it) or ('error', why).

    A null token is a moment without one; after ``quiet`` seconds of them ('alive', '') keeps the line open. Thoughts
    are left out.
    """
    hidden, whole, last = ThinkFilter(), "", clock()
    try:
        for token in tokens:
            text = hidden.feed(token) if token is not None else ""
            if text:
                whole, last = whole + text, clock()
                yield "delta", text
            elif clock() - last >= quiet:
                last = clock()
                yield "alive", ""
    except Exception as e:  # the provider's own
        yield "error", str(e)[:300]
        return
    if rest := hidden.close():
        yield "delta", rest
    yield "done", whole + rest


def listed(names: Iterable[str], first: Iterable[str] = ()) -> list[str]:
    """Models or presets as they are offered: the preferred ones as given, the others by name, each once."""
    head = list(dict.fromkeys(first))
    return head + sorted(set(names) - set(head), key=lambda x: (x.lower(), x))


Progress = Callable[[str], None]
