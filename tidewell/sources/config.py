"""The labelling configuration: which classes there are, and notes for the annotator."""

from __future__ import annotations

import json
from collections.abc import Callable

DEFAULT_CLASSES = ("sphere", "cube", "cone", "cylinder", "ring", "star", "arrow", "cross")
DEFAULT_NOTES = "- Annotate every visible object once.\n- Overlapping objects get a box each.\n"


class ConfigMissing(Exception):
    """Exit code 3."""


class ConfigInvalid(Exception):
    """Exit code 4."""


def load_config(path: str) -> dict:
    """{classes: [{name, description?}], prompt_notes}; there must be at least one class."""
    try:
        with open(path, encoding="utf-8") as f:
            got = json.load(f)
    except FileNotFoundError as e:
        raise ConfigMissing(f"{path} is missing; make it with the config command") from e
    except (OSError, ValueError) as e:
        raise ConfigInvalid(f"{path}: {e}") from e
    if not isinstance(got, dict) or not isinstance(got.get("classes"), list) or not got["classes"]:
        raise ConfigInvalid(f"{path} has no classes")
    return got


def parse_classes(text: str) -> list[str]:
    """Names between commas, trimmed, blanks dropped; the defaults for a blank text."""
    return [s for x in text.split(",") if (s := x.strip())] if text.strip() else list(DEFAULT_CLASSES)


def make_config(classes: list[str], descriptions: dict[str, str] | None = None, notes: str | None = None) -> dict:
    d = descriptions or {}
    return {"classes": [{"name": c, "description": d[c]} if d.get(c) else {"name": c} for c in classes], "prompt_notes": notes.strip("\n") + "\n" if notes and notes.strip() else DEFAULT_NOTES}


def save_config(config: dict, path: str) -> None:
    with open(path, "w", encoding="utf-8") as f:
        json.dump(config, f, indent=2, ensure_ascii=False)


def ask_yes_no(question: str, default: bool, read: Callable[[str], str] = input) -> bool:
    """Asks until the answer is yes, no or blank, which is the default."""
    while True:
        a = read(f"{question} [{'Y/n' if default else 'y/N'}] ").strip().lower()
        if a in ("", "y", "yes", "n", "no"):
            return default if not a else a[0] == "y"


def ask_lines(question: str, read: Callable[[str], str] = input) -> str:
    """Lines up to a blank one or the end of input."""
    out, prompt = [], question + "\n"
    while True:
        try:
            line = read(prompt)
        except EOFError:
            break
        if not line.strip():
            break
        out.append(line)
        prompt = ""
    return "\n".join(out)


def interview(read: Callable[[str], str] = input) -> dict:
    """The configuration from questions at a terminal."""
    names = parse_classes(read("Classes, with commas (blank for the defaults): "))
    about = {c: d for c in names if (d := read(f"Description of {c} (blank for none): ").strip())} if ask_yes_no("Describe the classes?", False, read) else {}
    notes = ask_lines("Notes for the annotator, up to a blank line:", read) if ask_yes_no("Add notes of your own?", False, read) else None
    return make_config(names, about, notes)
