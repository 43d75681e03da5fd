"""Model classifiers: what a configuration names, a guard model behind an HTTP endpoint, and a call that ends in time."""

from __future__ import annotations

import json
import math
import queue
import re
import threading
import urllib.request
from collections.abc import Callable, Mapping
from dataclasses import dataclass

Verdict = dict[str, object]
#: Where a local guard model answers, its name and its seconds, unless the configuration says otherwise.
ENDPOINT, MODEL, SECONDS = "http://127.0.0.1:11434/api/generate", "llama3-guard", 1.5


def verdict_of(reply: str | None) -> Verdict:
    """The first line says SAFE or UNSAFE, the second may begin with a confidence."""
    lines = re.split(r"\r?\n", (reply or "").strip())
    number = re.match(r"\s*[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?", lines[1] if len(lines) > 1 else "")
    given = float(number[0]) if number and math.isfinite(float(number[0])) else None
    word = lines[0].strip().upper()
    if word == "SAFE":
        return {"decision": "allow", "confidence": 0.1 if given is None else given}
    if word == "UNSAFE":
        return {"decision": "block", "confidence": 0.95 if given is None else given}
    return {"decision": "review", "confidence": 0.5}


def question(text: str, role: str = "user message") -> str:
    return f"Judge whether the {role} below is safe to pass on. Answer SAFE or UNSAFE on the first line, and on the second your confidence from 0 to 1.\n---\n{text}"


def _post(url: str, body: bytes, seconds: float) -> tuple[int, bytes]:
    request = urllib.request.Request(url, body, {"content-type": "application/json"}, method="POST")
    with urllib.request.urlopen(request, timeout=seconds) as reply:
        return reply.status, reply.read()


@dataclass(frozen=True)
class Endpoint:
    """A model that generates a reply to a prompt. ``transport``: (url, body, seconds) to (status, body), for tests."""

    url: str = ENDPOINT
    model: str = MODEL
    seconds: float = SECONDS
    transport: Callable[[str, bytes, float], tuple[int, bytes]] = _post

    def __call__(self, text: str) -> Verdict:
        status, body = self.transport(self.url, json.dumps({"model": self.model, "prompt": question(text), "stream": False}).encode(), self.seconds)
        if not 200 <= status < 300:
            raise ConnectionError(f"HTTP {status}")
        return verdict_of(str(json.loads(body).get("response") or ""))


def classifier(config: object) -> Callable[[str], Verdict | None] | None:
    """What a configuration names: a function, something with ``classify``, or an adapter by its name; None for anything else."""
    if callable(config):
        return config
    if isinstance(config, Mapping):
        if callable(config.get("classify")):
            return config["classify"]
        if config.get("adapter") == "ollama":
            given = {"url": config.get("endpoint"), "model": config.get("model"), "transport": config.get("transport"), "seconds": config["timeout_ms"] / 1000 if config.get("timeout_ms") else None}
            return Endpoint(**{k: v for k, v in given.items() if v is not None})
        return None
    found = getattr(config, "classify", None)
    return found if callable(found) else None


def within(seconds: float, call: Callable[[str], Verdict | None], text: str) -> Verdict | None:
    """``call(text)``, or TimeoutError after that many seconds; a call that hangs is left behind in a thread that ends with the worker."""
    got: queue.SimpleQueue = queue.SimpleQueue()

    def run() -> None:
        try:
            got.put((call(text), None))
        except Exception as e:
            got.put((None, e))

    threading.Thread(target=run, daemon=True).start()
    try:
        verdict, error = got.get(timeout=seconds)
    except queue.Empty:
        raise TimeoutError("classifier timeout") from None
    if error is not None:
        raise error
    return verdict
