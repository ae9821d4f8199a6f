"""Stand-ins for external models: Python functions that see a model name and prompts, nothing else."""

from __future__ import annotations

import hashlib

import regex

from ..functions.text import PROMPT_ANSWER, PROMPT_DOCUMENT, PROMPT_QUERY, STD_TOKEN_PATTERN
from ..operators.ledger import PermanentError


def _tokens(text: str) -> list[str]:
    return list(dict.fromkeys(regex.findall(STD_TOKEN_PATTERN, text.lower())))


def _line(llm: str, prompt: str) -> str:
    query, document = prompt.removeprefix(PROMPT_QUERY).removesuffix(PROMPT_ANSWER).split(PROMPT_DOCUMENT, 1)
    asked = set(_tokens(query))

    def score(line: str) -> float:
        own = _tokens(line)
        hit = [t for t in own if t in asked]
        return {"coverage": len(hit), "density": len(hit) / (len(own) + 1), "length": sum(map(len, hit))}[llm]

    return max(document.split("\n"), key=score)


def answer(llm, prompts):
    """Each prompt's document line that the model scores highest, the first of equals."""
    return [_line(llm, p).strip(" ") for p in prompts]


def answer_or_fail(llm, prompts):
    """The same, but every fourth prompt or so, by its hash, makes the call fail."""
    for p in prompts:
        if hashlib.md5(p.encode()).hexdigest()[0] < "4":
            raise RuntimeError("the model can't answer this")
    return answer(llm, prompts)


def answer_or_refuse(llm, prompts, system):
    """The same under a system prompt; by the prompt's hash, an eighth or so is refused for good and another eighth fails
    on each attempt."""
    for p in prompts:
        first = hashlib.md5(p.encode()).hexdigest()[0]
        if first < "2":
            raise PermanentError("refused")
        if first < "4":
            raise RuntimeError("no connection")
    return answer(llm, prompts)
