"""Plug-ins for vectors and reranking: what an engine takes as ``embedder`` and ``reranker``."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame

BATCH = 64


def batched(embed: Callable[[Sequence[str]], Sequence[Sequence[float]]], dimensions: int, batch: int = BATCH) -> Callable[[DataFrame], DataFrame]:
    """An embedder from a function on lists of texts, called in the workers with at most ``batch`` of them.

    A vector of another length is an error.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            vectors: list[list[float]] = []
            texts = frame["text"].fillna("").tolist()
            for at in range(0, len(texts), batch):
                own = [list(map(float, v)) for v in embed(texts[at : at + batch])]
                if len(own) != len(texts[at : at + batch]) or any(len(v) != dimensions for v in own):
                    raise ValueError(f"{dimensions} numbers are needed for each text")
                vectors += own
            yield pd.DataFrame({"id": frame["id"], "vector": vectors})

    return lambda texts: texts.select("id", "text").mapInPandas(run, "id long, vector array<float>")


def http_embedding(url: str, model: str, key: str = "", timeout: float = 45, attempts: int = 3, opener=urllib.request.urlopen) -> Callable[[Sequence[str]], list[list[float]]]:
    """Function for :func:`batched` that asks a service of the usual form: {model, input} -> {data: [{index, embedding}]}.

    Network errors, 429 and 5xx are tried again after 0.2, 0.4, ... seconds.
    """

    def embed(texts: Sequence[str]) -> list[list[float]]:
        body = json.dumps({"model": model, "input": list(texts)}).encode()
        headers = {"Content-Type": "application/json", **({"Authorization": f"Bearer {key}"} if key else {})}
        for attempt in range(1, attempts + 1):
            try:
                with opener(urllib.request.Request(url, body, headers), timeout=timeout) as answer:
                    data = json.load(answer)["data"]
                return [d["embedding"] for d in sorted(data, key=lambda d: d["index"])]
            except urllib.error.HTTPError as e:
                if attempt == attempts or not (e.code == 429 or e.code >= 500):
                    raise
            except OSError:
                if attempt == attempts:
                    raise
            time.sleep(0.2 * attempt)
        raise AssertionError

    return embed


def onnx_embedding(model_path: str, tokenizer_path: str, longest: int = 256) -> Callable[[Sequence[str]], list[list[float]]]:
    """Function for :func:`batched` over a sentence model in ONNX: mean of the token vectors, of length 1."""
    state: dict = {}

    def embed(texts: Sequence[str]) -> list[list[float]]:
        import numpy as np

        if not state:
            import onnxruntime
            from tokenizers import Tokenizer

            state["session"] = onnxruntime.InferenceSession(model_path)
            state["tokenizer"] = Tokenizer.from_file(tokenizer_path)
            state["tokenizer"].enable_truncation(longest)
            state["tokenizer"].enable_padding()
        encoded = state["tokenizer"].encode_batch(list(texts))
        mask = np.array([e.attention_mask for e in encoded], np.int64)
        given = {"input_ids": np.array([e.ids for e in encoded], np.int64), "attention_mask": mask, "token_type_ids": np.zeros_like(mask)}
        wanted = {i.name for i in state["session"].get_inputs()}
        tokens = state["session"].run(None, {k: v for k, v in given.items() if k in wanted})[0]
        mean = (tokens * mask[:, :, None]).sum(1) / np.maximum(mask.sum(1, keepdims=True), 1)
        return (mean / np.maximum(np.linalg.norm(mean, axis=1, keepdims=True), 1e-12)).tolist()

    return embed


def onnx_reranker(model_path: str, tokenizer_path: str, longest: int = 512) -> Callable[[str, list[str]], list[float]]:
    """A reranker over a cross-encoder in ONNX: one logit for each pair of query and document, padded to the longest."""
    state: dict = {}

    def score(query: str, documents: list[str]) -> list[float]:
        import numpy as np

        if not state:
            import onnxruntime
            from tokenizers import Tokenizer

            state["session"] = onnxruntime.InferenceSession(model_path)
            state["tokenizer"] = Tokenizer.from_file(tokenizer_path)
            state["tokenizer"].enable_truncation(longest)
            state["tokenizer"].enable_padding()
        encoded = state["tokenizer"].encode_batch([(query, d) for d in documents])
        given = {"input_ids": [e.ids for e in encoded], "attention_mask": [e.attention_mask for e in encoded], "token_type_ids": [e.type_ids for e in encoded]}
        wanted = {i.name for i in state["session"].get_inputs()}
        logits = state["session"].run(None, {k: np.array(v, np.int64) for k, v in given.items() if k in wanted})[0]
        return [float(x) for x in np.reshape(logits, (len(documents), -1))[:, 0]]

    return score
