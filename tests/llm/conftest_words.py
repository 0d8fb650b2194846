from __future__ import annotations

import re


def words_of(text: str) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", text)
