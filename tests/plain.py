"""Plain-Python statements of what the text operators should return, for small inputs."""

from __future__ import annotations

import re
import string


def is_title(line: str, before: str) -> bool:
    return line != line.lower() and len(line) <= 50 and (before == "" or before[-1] == ".")


def document(pages: list[str], title: list[str] | None = None) -> dict:
    numbered = [(p, l) for p, text in enumerate(pages) for l in text.split("\n")]
    texts = [l for _, l in numbered]
    flags = [is_title(l, texts[i - 1] if i else l) for i, l in enumerate(texts)]
    kept = [pl for pl, f in zip(numbered, flags) if not f]
    paragraphs, open_lines = [], []
    for page, line in kept:
        open_lines.append((page, line))
        if line.endswith("."):
            paragraphs.append((open_lines[0][0], " ".join(" ".join(l for _, l in open_lines).split())))
            open_lines = []
    cleaned = []
    for _, text in paragraphs:
        for width in range(len(title or []), 2, -1):
            for start in range(len(title) - width + 1):
                text = text.replace(" ".join(title[start:start + width]), "")
        text = re.sub(r"[(\[].*?[)\]]", "", text).lower()
        cleaned.append("".join(c for c in text if c not in string.punctuation))
    return {"lines": numbered, "kept": kept, "n_titles": sum(flags), "paragraphs": paragraphs, "clean": cleaned}


def words(text: str) -> list[str]:
    return re.findall(r"\w+", text.lower())


def first_index(tokens: list[str], phrase: str):
    parts = phrase.split(" ")
    for i in range(len(tokens) - len(parts) + 1):
        if tokens[i:i + len(parts)] == parts:
            return i
    return None


def distance(tokens: list[str], left: list[str], right: list[str]) -> int:
    a = sorted(p for p in (first_index(tokens, x) for x in left) if p is not None)
    b = sorted(p for p in (first_index(tokens, x) for x in right) if p is not None)
    return min((abs(x - y) for x, y in zip(a, b)), default=999)
