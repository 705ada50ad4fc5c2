"""python -m almanac.cli --base FOLDER VERB ... : the knowledge base's verbs on a command line."""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Sequence

from almanac.api import READERS, SKILLS, KnowledgeBase
from almanac.operators.enrich import STEPS, backend
from almanac.serve import http_server, rows, stdio
from almanac.session import build_session


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="almanac")
    top.add_argument("--base", required=True, help="folder of the knowledge base")
    verbs = top.add_subparsers(dest="verb", required=True)
    for verb in ("add", "update"):
        own = verbs.add_parser(verb)
        own.add_argument("name")
        own.add_argument("--raw", required=True)
        own.add_argument("--format", required=True, choices=sorted(READERS))
        own.add_argument("--privacy", type=int, choices=range(4))
    verbs.add_parser("delete").add_argument("name")
    verbs.add_parser("build-index").add_argument("name", nargs="?")
    for verb in ("sources", "status"):
        verbs.add_parser(verb)
    own = verbs.add_parser("search")
    own.add_argument("query")
    own.add_argument("--mode", default="normal", choices=("quick", "normal", "deep"))
    own.add_argument("--limit", type=int)
    own.add_argument("--source")
    own.add_argument("--personal-only", action="store_true")
    own.add_argument("--public-only", action="store_true")
    own = verbs.add_parser("read")
    own.add_argument("reference")
    own.add_argument("--section")
    for verb, word in (("entity", "name"), ("lookup", "question")):
        verbs.add_parser(verb).add_argument(word)
    own = verbs.add_parser("ask")
    own.add_argument("skill", choices=sorted(SKILLS))
    own.add_argument("question")
    own = verbs.add_parser("substring")
    own.add_argument("pattern")
    own.add_argument("--limit", type=int, default=10)
    own = verbs.add_parser("enrich")
    own.add_argument("step", choices=sorted(STEPS))
    own.add_argument("--model", default="skip", help='"skip", or JSON with kind, url and model')
    own.add_argument("--limit", type=int, default=0)
    own.add_argument("--source")
    own = verbs.add_parser("export")
    own.add_argument("path")
    own.add_argument("--include-personal", action="store_true")
    verbs.add_parser("import").add_argument("path")
    own = verbs.add_parser("serve")
    own.add_argument("--port", type=int, default=8080)
    own.add_argument("--stdio", action="store_true")
    return top


def main(argv: Sequence[str] | None = None, kb: KnowledgeBase | None = None) -> int:
    given = parser().parse_args(argv)
    kb = kb or KnowledgeBase(build_session(), given.base)
    said: object = None
    if given.verb == "add":
        said = kb.add_source(given.name, given.raw, given.format, given.privacy)
    elif given.verb == "update":
        said = kb.update_source(given.name, given.raw, given.format, given.privacy)
    elif given.verb == "delete":
        kb.delete(given.name)
    elif given.verb == "build-index":
        kb.build_index(given.name)
    elif given.verb == "sources":
        said = rows(kb.list_sources())
    elif given.verb == "status":
        said = rows(kb.status())
    elif given.verb == "search":
        said = rows(kb.search(given.query, given.mode, given.limit, given.source, given.personal_only, given.public_only))
    elif given.verb == "read":
        said = kb.read(given.reference, given.section)
    elif given.verb == "entity":
        said = rows(kb.entity(given.name)) or {"suggestions": rows(kb.suggest(given.name))}
    elif given.verb == "lookup":
        said = rows(kb.lookup(given.question))
    elif given.verb == "ask":
        said = rows(kb.ask(given.skill, given.question))
    elif given.verb == "substring":
        said = rows(kb.substring(given.pattern, given.limit))
    elif given.verb == "enrich":
        kb.model = backend(given.model if given.model == "skip" else json.loads(given.model))
        said = rows(kb.enrich(given.step, given.limit, given.source))
    elif given.verb == "export":
        said = {"documents": kb.export(given.path, given.include_personal)}
    elif given.verb == "import":
        said = {"sources": list(kb.import_(given.path))}
    elif given.stdio:
        stdio(kb)
    else:
        http_server(kb, port=given.port).serve_forever()
    if said is not None:
        sys.stdout.write((said if isinstance(said, str) else json.dumps(said, ensure_ascii=False, indent=1)) + "\n")
    return 0


if __name__ == "__main__":
    sys.exit(main())
