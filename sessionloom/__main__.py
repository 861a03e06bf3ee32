"""python -m sessionloom STORE COMMAND [WORDS]: the calls of :class:`sessionloom.api.Engine` over a store.

index FOLDERS (--project, --rollouts, --repo), status, sources; search, all (all projects; --offset, --source), similar, words, decisions,
mistakes, requirements, validations, methodologies, findings, solutions; check PATH, file PATH, history, commits, sessions;
handoff (--project, --session), handoffs, resume [ID]; maintain, report, forget TOPIC (--confirm).
"""

from __future__ import annotations

import argparse
import time

from sessionloom.api import Engine
from sessionloom.session import session


#: Commands that show rows: engine, words as one text or None, arguments.
SHOWN = {
    "sources": lambda e, text, a: e.sources(),
    "search": lambda e, text, a: e.search(text, a.limit, project=a.project or None, source=a.source),
    "all": lambda e, text, a: e.search_all(text, a.limit, a.offset, source=a.source),
    "similar": lambda e, text, a: e.search(text, a.limit, by_session=True),
    "words": lambda e, text, a: e.search_words(text, a.limit),
    "decisions": lambda e, text, a: e.decisions(text or None, a.limit),
    "mistakes": lambda e, text, a: e.mistakes(text or None, limit=a.limit),
    "requirements": lambda e, text, a: e.requirements(text, limit=a.limit),
    "validations": lambda e, text, a: e.validations(a.limit),
    "methodologies": lambda e, text, a: e.facts("methodologies", text or None, a.limit),
    "findings": lambda e, text, a: e.facts("research_findings", text or None, a.limit),
    "solutions": lambda e, text, a: e.facts("solution_patterns", text or None, a.limit),
    "check": lambda e, text, a: e.check_before_modify(text, a.limit),
    "file": lambda e, text, a: e.file_timeline(text),
    "history": lambda e, text, a: e.tool_history(text=text or None),
    "commits": lambda e, text, a: e.commits(text or None, a.limit, a.project or None),
    "sessions": lambda e, text, a: e.sessions(a.limit),
    "handoff": lambda e, text, a: e.hand_off(a.project, a.session, a.now),
    "handoffs": lambda e, text, a: e.handoffs(a.project or None, a.resumed, a.limit),
    "resume": lambda e, text, a: e.resume(a.project, a.session, a.now, text or None),
    "maintain": lambda e, text, a: e.maintain(a.now),
}
#: Commands that print what they return.
PRINTED = {
    "index": lambda e, text, a: e.index(a.project, a.words, a.now, rollouts=a.rollouts, repo=a.repo),
    "status": lambda e, text, a: e.statistics(),
    "report": lambda e, text, a: e.report(a.project or text),
    "forget": lambda e, text, a: e.forget_topic(text, confirm=a.confirm),
}


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="sessionloom")
    p.add_argument("store")
    p.add_argument("command", choices=[*SHOWN, *PRINTED])
    p.add_argument("words", nargs="*")
    for name, default in (("project", ""), ("session", "current"), ("source", None), ("repo", None)):
        p.add_argument(f"--{name}", default=default)
    for name, default in (("limit", 10), ("offset", 0), ("now", int(time.time() * 1000))):
        p.add_argument(f"--{name}", type=int, default=default)
    for name in ("rollouts", "resumed", "confirm"):
        p.add_argument(f"--{name}", action="store_true")
    a = p.parse_args(argv)
    e, text = Engine(session(), a.store), " ".join(a.words)
    if a.command in PRINTED:
        print(PRINTED[a.command](e, text, a))
    elif (rows := SHOWN[a.command](e, text, a)) is None:
        print("none")
    else:
        rows.show(a.limit, truncate=120)


if __name__ == "__main__":
    main()
