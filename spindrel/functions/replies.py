"""Repair and parsing of one reply in Python, for steps that call a model."""

from __future__ import annotations

import json
import re


def sanitize(reply: str, close_brace: str = "objects") -> str:
    text = re.sub(r"^```(?:json)?", "", reply.strip())
    text = re.sub(r"```\s*$", "", text).strip()
    text = re.sub(r",\s*([\]}])", r"\1", text)
    text = re.sub(r"[\r\n]+", " ", text).strip()
    if not text.endswith("}") and (close_brace == "always" or text.startswith("{")):
        text += "}"
    return text


def parse(reply: str) -> object:
    return json.loads(sanitize(reply))
