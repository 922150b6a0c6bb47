"""Models behind HTTP services that speak the public chat-completions and embeddings formats. Standard library alone; they run in Python tasks."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request
from dataclasses import dataclass, field

import numpy as np


@dataclass
class _Service:
    """``url`` ends before /chat/completions or /embeddings. ``api_version`` is sent as a parameter, and the key as api-key, where a service wants it so."""

    url: str
    model: str
    key: str = ""
    api_version: str = ""
    timeout_s: float = 300.0
    attempts: int = 2
    wait_s: float = 1.0
    extra: dict = field(default_factory=dict)

    def _post(self, path: str, body: dict) -> dict:
        address = f"{self.url.rstrip('/')}/{path}" + (f"?{urllib.parse.urlencode({'api-version': self.api_version})}" if self.api_version else "")
        headers = {"Content-Type": "application/json"} | ({"api-key": self.key} if self.key and self.api_version else {"Authorization": f"Bearer {self.key}"} if self.key else {})
        request = urllib.request.Request(address, json.dumps(body).encode(), headers)
        for turn in range(self.attempts):
            try:
                with urllib.request.urlopen(request, timeout=self.timeout_s) as answer:
                    return json.loads(answer.read())
            except urllib.error.HTTPError as e:
                if turn + 1 == self.attempts or e.code < 500 and e.code not in (408, 429):  # a wrong request stays wrong
                    raise
            except OSError:
                if turn + 1 == self.attempts:
                    raise
            time.sleep(self.wait_s)
        raise ValueError("attempts must be at least 1")


@dataclass
class HttpChat(_Service):
    """A Generator."""

    temperature: float = 0.0
    seed: int | None = None
    max_tokens: int = 2048

    def __call__(self, messages: list[dict[str, str]]) -> tuple[str, dict]:
        body = {"model": self.model, "messages": messages, "temperature": self.temperature, "max_tokens": self.max_tokens} | ({} if self.seed is None else {"seed": self.seed}) | self.extra
        got = self._post("chat/completions", body)
        usage = got.get("usage") or {}
        return got["choices"][0]["message"]["content"], {"prompt_tokens": usage.get("prompt_tokens", 0), "completion_tokens": usage.get("completion_tokens", 0), "finish_reason": got["choices"][0].get("finish_reason")}


@dataclass
class HttpEmbedder(_Service):
    """An Embedder. An instruction goes before each text."""

    def __call__(self, texts: list[str], instruction: str | None = None) -> np.ndarray:
        asked = [f"Instruct: {instruction}\nQuery: {t}" for t in texts] if instruction else list(texts)
        got = self._post("embeddings", {"model": self.model, "input": asked} | self.extra)
        return np.array([x["embedding"] for x in sorted(got["data"], key=lambda x: x["index"])], np.float32)


@dataclass
class Guided:
    """A BatchGenerator of a Generator that can follow a schema: the schema goes with each prompt as its response format."""

    chat: HttpChat

    def batch(self, many: list[list[dict[str, str]]], json_schema: dict | None = None) -> list[tuple[str, dict]]:
        extra = {"response_format": {"type": "json_schema", "json_schema": {"name": "answer", "schema": json_schema}}} if json_schema else {}
        kept = self.chat.extra
        self.chat.extra = kept | extra
        try:
            return [self.chat(m) for m in many]
        finally:
            self.chat.extra = kept
