"""What models have to offer, and local stand-ins, named as such: their scores can't be compared with those of real models.

A port is used a batch at a time inside a task, so it must pickle. `NAMES` gives the stand-in of each.
"""

from __future__ import annotations

import hashlib
import re
from typing import Protocol

import numpy as np
import regex


class EmbeddingModel(Protocol):
    """One with `additive` set gives for texts joined by white space the sum of their vectors, so that texts that share parts needn't be
    embedded each."""

    identity: str
    dimensions: int

    def embed(self, texts: list[str]) -> np.ndarray: ...


class Reranker(Protocol):
    def score(self, questions: list[str], texts: list[str]) -> list[float]: ...


class Contextualizer(Protocol):
    def context(self, document: str, chunk: str) -> str: ...


class Summarizer(Protocol):
    def summarize(self, texts: list[str]) -> str: ...


class DocumentSummarizer(Protocol):
    def summarize_document(self, text: str) -> str: ...


class AnswerGenerator(Protocol):
    identity: str

    def answer(self, question: str, context: list[tuple[list[str], str]]) -> str: ...


class SupportVerifier(Protocol):
    identity: str

    def verify(self, question: str, claim: str, cited: list[tuple[str, str]]) -> str: ...


class AnswerRewriter(Protocol):
    identity: str

    def rewrite(self, question: str, answer: str, sources: list[str]) -> str: ...


class QualityJudge(Protocol):
    def judge(self, question: str, answer: str, contexts: list[str]) -> dict[str, float]: ...


class TextExtractor(Protocol):
    def extract(self, raw: bytes) -> str: ...


WORD = regex.compile(r"[\p{L}\p{N}]+")


def words(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


class HashedTerms:
    """Stand-in for an embedding model: how often a text's words fall into each bucket of their md5."""

    additive = True

    def __init__(self, dimensions: int = 64):
        self.dimensions = dimensions
        self.identity = f"hashed-terms-{dimensions}"
        self.place = _Places(dimensions)

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dimensions))
        for row, text in zip(out, texts):
            own = words(text)
            row[:] = np.bincount(np.fromiter(map(self.place.__getitem__, own), np.intp, len(own)), minlength=self.dimensions)
        return out


class _Places(dict):
    """The bucket of each word; a memo of bounded size."""

    def __init__(self, dimensions: int):
        self.dimensions = dimensions

    def __missing__(self, word: str) -> int:
        if len(self) > 100_000:
            self.clear()
        at = self[word] = int(hashlib.md5(word.encode()).hexdigest()[:4], 16) % self.dimensions
        return at

    def __reduce__(self):
        return _Places, (self.dimensions,)


class SharedTerms:
    """Stand-in for a scorer of pairs: the share of the question's words that the text holds."""

    def score(self, questions: list[str], texts: list[str]) -> list[float]:
        both = ((set(words(q)), set(words(t))) for q, t in zip(questions, texts))
        return [round(len(q & t) / len(q), 6) if q else 0.0 for q, t in both]


class LeadText:
    """Stand-in for contexts and summaries: the beginning of the first line."""

    def __init__(self, size: int = 120):
        self.size = size

    def summarize_document(self, text: str) -> str:
        return (text or "").split("\n", 1)[0][: self.size]

    def context(self, document: str, chunk: str) -> str:
        return self.summarize_document(document)

    def summarize(self, texts: list[str]) -> str:
        return " ".join(self.summarize_document(t) for t in texts)


class Extractive:
    """Stand-in for a generator: the first sentence of each source with its first id; with `echo` after as many words of the question."""

    def __init__(self, echo: int = 0):
        self.echo, self.identity = echo, f"extractive-{echo}"

    def answer(self, question: str, context: list[tuple[list[str], str]]) -> str:
        lead = f"Segundo a fonte, {' '.join(words(question)[: self.echo])} " if self.echo else ""
        firsts = [(ids[0], re.split(r"(?<=[.!?])[ \t\r\n]", text.strip(" \t\r\n"), maxsplit=1)[0]) for ids, text in context if ids and text and text.strip(" \t\r\n")]
        said = [f"{lead}{first.rstrip('.!?').replace('[', '(').replace(']', ')')} [{ref}]." for ref, first in firsts]
        return " ".join(said) or "Não há evidência suficiente nas fontes recuperadas."


class Containment:
    """Stand-in for the verifier, the rewriter and the judge: a claim is supported when the cited texts hold `share` of its words."""

    def __init__(self, share: float = 0.8):
        self.share, self.identity = share, f"containment-{share}"

    def held(self, claim: str, texts: list[str]) -> float:
        own = set(words(re.sub(r"\[[^\[\]]*\]", "", claim)))
        return len(own & {w for t in texts for w in words(t)}) / len(own) if own else 0.0

    def verify(self, question: str, claim: str, cited: list[tuple[str, str]]) -> str:
        part = self.held(claim, [t for _, t in cited])
        return "supported" if part >= self.share else "partially_supported" if part >= self.share / 2 else "unsupported"

    def rewrite(self, question: str, answer: str, sources: list[str]) -> str:
        said = re.split(r'(?<=[.!?])\s+(?=[A-ZÀ-Ú"\[])', answer)
        return " ".join(s for s in said if self.held(s, sources) >= self.share)

    def judge(self, question: str, answer: str, contexts: list[str]) -> dict[str, float]:
        return {"faithfulness": self.held(answer, contexts), "answer_relevancy": self.held(question, [answer]), "abstention_appropriate": float(not contexts)}


class Decoded:
    """An extractor of plain text: UTF-8, else Windows-1252."""

    def extract(self, raw: bytes) -> str:
        try:
            return raw.decode("utf-8")
        except UnicodeDecodeError:
            return raw.decode("cp1252", "replace")


NAMES = {
    EmbeddingModel: HashedTerms, Reranker: SharedTerms, Contextualizer: LeadText, Summarizer: LeadText, DocumentSummarizer: LeadText, AnswerGenerator: Extractive,
    SupportVerifier: Containment, AnswerRewriter: Containment, QualityJudge: Containment, TextExtractor: Decoded,
}
