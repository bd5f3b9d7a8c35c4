"""The port to a language model: a callable from prompt to text, None for an error."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import DataFrame

LanguageModel = Callable[[str], str | None]


def offline(prompt: str) -> str | None:
    """The default: no model can be reached, every call is an error."""
    return None


def completion_client(post: Callable[[dict], tuple[int, str]], token: str, identifier: str) -> LanguageModel:
    """A model behind an HTTP completion service.

    post sends a JSON body and returns (status, body). The answer lies in the body's payload: the text of its first choice,
    else its own text, whichever isn't empty. Any other status than 200, a body whose status is Failure, one that isn't JSON
    and one without an answer are errors.
    """

    def ask(prompt: str) -> str | None:
        try:
            status, body = post({"token": token, "prompt": prompt, "identifier": identifier})
            reply = json.loads(body) if status == 200 else None
        except (OSError, ValueError):
            return None
        if not isinstance(reply, dict) or reply.get("status") == "Failure" or not isinstance(payload := reply.get("payload"), dict):
            return None
        choices = payload.get("choices")
        first = choices[0] if isinstance(choices, list) and choices and isinstance(choices[0], dict) else {}
        return next((str(x) for x in (first.get("text"), payload.get("text")) if x), None)

    return ask


#: Calls that a task has under way at once, and attempts at a prompt.
AT_ONCE, ATTEMPTS = 4, 3


def called(prompts: DataFrame, model: Callable[[], LanguageModel], at_once: int = AT_ONCE, attempts: int = ATTEMPTS) -> DataFrame:
    """(prompt, response, attempts) of each distinct prompt of prompts (prompt): a model as a partitioned source.

    model makes a client; each task makes its own and has at most at_once calls under way. A call without an answer, or
    one that raises, is made again, and is a row with a null response after the last attempt: an error ends no job. Null
    prompts aren't asked. A lost executor costs the calls of its own tasks. Results go to a table before they are used
    twice, as else each use calls anew.
    """

    def ask(client: LanguageModel, prompt: str) -> tuple[str, str | None, int]:
        for attempt in range(1, attempts + 1):
            try:
                said = client(prompt)
            except Exception:
                said = None
            if said is not None:
                return prompt, said, attempt
        return prompt, None, attempts

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = model()
        with ThreadPoolExecutor(at_once) as pool:
            for frame in frames:
                rows = list(pool.map(lambda p: ask(client, p), frame["prompt"]))
                yield pd.DataFrame(rows, columns=["prompt", "response", "attempts"])

    return prompts.select("prompt").where("prompt is not null").distinct().mapInPandas(run, "prompt string, response string, attempts int")
