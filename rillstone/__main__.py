"""python -m rillstone STORE put|get|delete|scan|vector-search|stats|verify|compact|backup ARGUMENTS"""

from __future__ import annotations

import json
import sys

from rillstone.session import local_session
from rillstone.store import Store, identity


def main(args: list[str]) -> int:
    if len(args) < 2:
        print(__doc__)
        return 2
    store = Store(local_session(), args[0])
    of = lambda key: identity("cli", "default", "records", "main", key)
    command, rest = args[1], args[2:]
    if command == "put":
        value = [float(x) for x in rest[1].split(",")] if "--vector" in rest else rest[1]
        out = store.put(of(rest[0]), value).sequence
    elif command == "get":
        row = store.get(of(rest[0]))
        out = row and row["payload"]
    elif command == "delete":
        out = store.delete(of(rest[0])).sequence
    elif command == "scan":
        rows = store.scan_prefix((b"cli",), rest[0].encode() if rest else b"").select("key", "payload").collect()
        out = {bytes(r["key"]).decode(): r["payload"].asDict(True) for r in rows}
    elif command == "vector-search":
        rows = store.vector_exact("cli", "default", "records", [float(x) for x in rest[0].split(",")], int(rest[1]) if len(rest) > 1 else 10).collect()
        out = [[bytes(r["key"]).decode(), r["score"]] for r in rows]
    elif command in ("stats", "verify", "compact"):
        out = getattr(store, command)()
    elif command == "backup":
        out = store.backup(rest[0])
    else:
        print(__doc__)
        return 2
    print(json.dumps(out, indent=2, default=lambda x: bytes(x).hex()))
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
