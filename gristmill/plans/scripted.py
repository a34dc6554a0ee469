"""Stand-ins for models, answering by rule: what queries and tests ask where there is no network."""

from __future__ import annotations

import json
import re


def first_pass(system: str, prompt: str) -> str:
    """Positions by words; texts on licenses make it fail, as a service might."""
    text = prompt.split("\n", 1)[-1] if prompt.startswith("Submitter: ") else prompt
    if re.search("licen[cs]e", text, re.IGNORECASE):
        raise RuntimeError("no answer")
    return second_model(system, prompt)


def second_model(system: str, prompt: str) -> str:
    tags = ["Position: Oppose"] if re.search("idiot|disgusting", prompt, re.IGNORECASE) else ["Position: Support"] if re.search(r"\bthe\b", prompt, re.IGNORECASE) else []
    return json.dumps({"stances": [*tags, "Position: Invented"], "entity_type": "Organization" if "copyright" in prompt.lower() else "Robot", "key_quote": "", "rationale": "by words"})


def second_pass(system: str, prompt: str) -> str:
    """A verdict by the words of the text it is shown."""
    verdict = "Oppose" if re.search("idiot|disgusting", prompt, re.IGNORECASE) else "Support" if re.search(r"\bthe\b", prompt, re.IGNORECASE) else "Unclear"
    return json.dumps({"verified_stance": verdict, "reasoning": "by words"})
