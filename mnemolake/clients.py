"""Language-model clients for proposals: each a function from a transcript to a reply, given by the caller, run as a command, or canned for tests."""

from __future__ import annotations

import json
import os
import subprocess
from collections.abc import Callable

#: Set in the environment of a command that asks a model, so that hooks which run inside it do nothing.
GUARD = "MNEMOLAKE_HOOK_ACTIVE"

INSTRUCTIONS = (
    "Read the transcript and list lasting memories as JSON: {\"memories\": [{\"content\", \"type\" (semantic, procedural or episodic), \"slot\" or null, "
    "\"valid_from\" and \"valid_to\" as ISO dates or null, \"confidence\" from 0 to 1, \"sources\" (message numbers), \"supersedes_previous\"}]}. "
    "Give only what the messages say, with the numbers of the messages that say it."
)


class Command:
    """Runs a program with the instructions and the transcript, and reads the JSON that it prints: an object with `structured_output` or `result`, or the reply itself.

    `arguments` are the program and its options; `{system}` and `{user}` stand for the two texts. A failure raises, and the chunk is passed over.
    """

    def __init__(self, arguments: list[str], timeout: float = 180.0, runner: Callable[..., subprocess.CompletedProcess] | None = None, hidden: tuple[str, ...] = ()) -> None:
        self.arguments, self.timeout, self.runner, self.hidden = arguments, timeout, runner or subprocess.run, hidden

    def environment(self) -> dict[str, str]:
        return {k: v for k, v in os.environ.items() if k not in self.hidden} | {GUARD: "1"}

    def __call__(self, transcript: str) -> str:
        said = [a.replace("{system}", INSTRUCTIONS).replace("{user}", transcript) for a in self.arguments]
        done = self.runner(said, capture_output=True, text=True, env=self.environment(), stdin=subprocess.DEVNULL, timeout=self.timeout)
        if done.returncode != 0:
            raise RuntimeError(f"{said[0]} ended with {done.returncode}: {done.stderr.strip()[:300]}")
        try:
            held = json.loads(done.stdout)
        except json.JSONDecodeError:
            return done.stdout
        if not isinstance(held, dict) or held.get("is_error"):
            raise RuntimeError(f"{said[0]} gave no result")
        if held.get("structured_output") is not None:
            return json.dumps(held["structured_output"])
        return held["result"] if isinstance(held.get("result"), str) else done.stdout


class Service:
    """A client of a library: `create(system=..., user=...)` gives the reply's text; a refusal, an empty reply, raises."""

    def __init__(self, create: Callable[..., str | None]) -> None:
        self.create = create

    def __call__(self, transcript: str) -> str:
        reply = self.create(system=INSTRUCTIONS, user=transcript)
        if not reply:
            raise RuntimeError("no reply")
        return reply


class Canned:
    """Replies in turn, then none; or a function of the transcript. Keeps what it was asked."""

    def __init__(self, replies: list[str] | Callable[[str], str]) -> None:
        self.replies, self.asked = replies, []

    def __call__(self, transcript: str) -> str:
        self.asked.append(transcript)
        if callable(self.replies):
            return self.replies(transcript)
        return self.replies[len(self.asked) - 1] if len(self.asked) <= len(self.replies) else '{"memories": []}'


def make(kind: str, what) -> Callable[[str], str]:  # noqa: ANN001
    """The client named: command (its arguments), service (its function) or canned (its replies)."""
    kinds = {"command": Command, "service": Service, "canned": Canned}
    if kind not in kinds:
        raise ValueError(f"unknown client {kind!r}: one of {', '.join(kinds)}")
    return kinds[kind](what)
