"""Model-backed steps behind interfaces: language predictors and judges, with offline stand-ins."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame

from ..functions.judge_json import KEYS, POLARITY, REPLY, SUBJECTIVITY, VOICE, parse_text


@dataclass(frozen=True)
class JudgeSpec:
    """What a run of a judge is pinned to. awq names a build of the model in that quantization, with its own revision."""

    name: str
    repo_id: str
    revision: str | None = None
    quantization: str | None = None
    max_model_len: int = 1536
    max_num_seqs: int = 96
    prefix_caching: bool = True
    seed: int = 42
    awq: tuple[str, str | None] | None = None

    def pinned(self) -> JudgeSpec:
        if self.revision in (None, "", "main"):
            raise ValueError(f"{self.name}: a revision must be pinned before a run")
        return self

    def loaded(self, mode: str = "auto") -> JudgeSpec:
        """The spec that a run loads: auto prefers the awq build, awq asks for it, bnb for four bits of the model itself."""
        build = replace(self, repo_id=self.awq[0], revision=self.awq[1], quantization="awq", awq=None) if self.awq else self
        found = {"auto": build, "awq": build, "bnb": replace(self, awq=None)}[mode]
        if mode != "auto" and found.quantization != {"awq": "awq", "bnb": "bitsandbytes-4bit"}[mode]:
            raise ValueError(f"{self.name} has no {mode} build")
        return found


_FOUR = "bitsandbytes-4bit"
#: The judges of the committee.
JUDGES = {
    s.name: s
    for s in (
        JudgeSpec("llama-3.1-8b", "meta-llama/Llama-3.1-8B-Instruct", "main", _FOUR, awq=("hugging-quants/Meta-Llama-3.1-8B-Instruct-AWQ-INT4", "db1f81ad4b8c7e39777509fac66c652eb0a52f91")),
        JudgeSpec("gemma-2-9b", "google/gemma-2-9b-it", "main", _FOUR, prefix_caching=False, awq=("hugging-quants/gemma-2-9b-it-AWQ-INT4", "6e62725da8e92309167814dad7aacc0ed8cb2484")),
        JudgeSpec("qwen2.5-14b", "Qwen/Qwen2.5-14B-Instruct-AWQ", "539535859b135b0244c91f3e59816150c8056698", "awq"),
        JudgeSpec("mistral-nemo-12b", "mistralai/Mistral-Nemo-Instruct-2407", "main", _FOUR, awq=("casperhansen/mistral-nemo-instruct-2407-awq", "c83b6438e13051ad1c0f5683635705ee83bb8772")),
        JudgeSpec("aya-expanse-8b", "CohereForAI/aya-expanse-8b", "main", _FOUR, awq=("Orion-zhen/aya-expanse-8b-AWQ", "ff52d61b71c613180581c3a4c6b3b3f636ce79e5")),
        JudgeSpec("indic", "ai4bharat/Airavata", "main", _FOUR),
    )
}
# Where replies stop, and the engine settings below.
STOPS = ["}\n\n", "\n\n\n", " | ", "|{", "Note:", "Please provide"]


def engine_settings(spec: JudgeSpec, gpus: int = 1) -> dict:
    """Arguments of the inference engine for a spec that `loaded` chose; its revision must be pinned."""
    kept = {"awq": {"quantization": "awq"}, _FOUR: {"quantization": "bitsandbytes", "load_format": "bitsandbytes"}}.get(spec.pinned().quantization, {})
    limits = {"max_model_len": spec.max_model_len, "max_num_seqs": spec.max_num_seqs, "enable_prefix_caching": spec.prefix_caching, "gpu_memory_utilization": 0.9, "swap_space": 2}
    return {"model": spec.repo_id, "revision": spec.revision, "dtype": "float16", "seed": spec.seed, "tensor_parallel_size": min(2, max(1, gpus)), "guided_decoding_backend": "xgrammar"} | limits | kept


def sampling_settings(guided: bool = True, rationale: bool = True, seed: int = 42) -> dict:
    """Arguments of greedy decoding. A stop text stays in the reply, as one of them holds the object's closing brace."""
    greedy = {"temperature": 0.0, "seed": seed, "max_tokens": 320, "stop": STOPS, "include_stop_str_in_output": True}
    return greedy | ({"guided_json": reply_schema(rationale)} if guided else {})


class JudgeBackend(Protocol):
    def generate(self, prompts: list[str]) -> list[str]: ...


class StandIn:
    """Replies made from a hash of the prompt: the same everywhere, valid, of no meaning."""

    def generate(self, prompts: list[str]) -> list[str]:
        out = []
        for p in prompts:
            h = hashlib.md5(p.encode()).digest()
            subjectivity = SUBJECTIVITY[h[0] % 2]
            out.append(json.dumps({"subjectivity": subjectivity, "polarity": None if subjectivity == "objective" else POLARITY[h[1] % 4], "confidence": h[2] % 101 / 100, "domain": "general", "narrative_voice": VOICE[h[3] % 3], "sentiment_target": None, "rationale": "stand-in"}))
        return out


def reply_schema(rationale: bool = True) -> dict:
    """JSON schema of a reply: polarity is null if and only if the text is objective."""
    common = {"confidence": {"type": "number", "minimum": 0, "maximum": 1}, "domain": {"type": "string", "minLength": 1}, "narrative_voice": {"enum": VOICE}, "sentiment_target": {"type": ["string", "null"]}}
    if rationale:
        common["rationale"] = {"type": "string", "minLength": 1}
    branch = lambda s, p: {"type": "object", "properties": {"subjectivity": {"const": s}, "polarity": p} | common, "required": KEYS if rationale else KEYS[:-1], "additionalProperties": False}
    return {"anyOf": [branch("objective", {"type": "null"}), branch("subjective", {"enum": POLARITY})]}


def verdict_or_error(judge: Callable[[str], dict], other: str = "other") -> Callable[[str], dict]:
    """A language judge whose exceptions become verdicts: `other`, confidence 0, and the error as reason."""

    def run(text: str) -> dict:
        try:
            return judge(text)
        except Exception as e:  # noqa: BLE001  whatever a backend raises is a verdict, not the end of the job
            return {"label": other, "confidence": 0.0, "reason": f"error: {e}"[:80]}

    return run


def judged(items: DataFrame, make_backend: Callable[[], JudgeBackend], prompt: Callable[[str], str], judge: str, batch: int = 64, rationale: bool = True) -> DataFrame:
    """id, judge, reply fields, parse_failed, raw_response: batches with one retry of replies that do not parse. The
    backend is made once per task, and only if there is work."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        backend = None
        for b in batches:
            for at in range(0, len(b), batch):
                part = b.iloc[at : at + batch]
                backend = backend or make_backend()
                prompts = [prompt(t) for t in part["text"]]
                raw = backend.generate(prompts)
                parsed = [parse_text(r, rationale) for r in raw]
                again = [i for i, p in enumerate(parsed) if p is None]
                if again:
                    for i, r in zip(again, backend.generate([prompts[i] for i in again]), strict=True):
                        raw[i], parsed[i] = r, parse_text(r, rationale)
                rows = [(*((p or {}).get(k) for k in KEYS), p is None, None if p else r) for p, r in zip(parsed, raw, strict=True)]
                out = pd.DataFrame(rows, columns=[*KEYS, "parse_failed", "raw_response"])
                out.insert(0, "id", part["id"].to_numpy())
                out.insert(1, "judge", judge)
                yield out.astype({"confidence": "float64"})

    kind = dict(items.dtypes)["id"]
    return items.select("id", "text").mapInPandas(run, f"id {kind}, judge string, {REPLY}, parse_failed boolean, raw_response string")


def language_predicted(items: DataFrame, make_predictor: Callable[[], Callable[[list[str]], list[tuple[str, float]]]], batch: int = 2000) -> DataFrame:
    """id, lid_model_label, lid_model_confidence (4 digits) from a predictor made once per task; empty text is a space."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        predict = None
        for b in batches:
            for at in range(0, len(b), batch):
                part = b.iloc[at : at + batch]
                predict = predict or make_predictor()
                found = predict([t.replace("\n", " ") if t else " " for t in part["text"]])
                yield pd.DataFrame({"id": part["id"].to_numpy(), "lid_model_label": [x for x, _ in found], "lid_model_confidence": [round(float(c), 4) for _, c in found]})

    kind = dict(items.dtypes)["id"]
    return items.select("id", "text").mapInPandas(run, f"id {kind}, lid_model_label string, lid_model_confidence double")
