"""Random ledgers and a plain, row-by-row reading of the fold rules."""

from __future__ import annotations

import random

SCHEMA = (
    "seq long, name string, slot long, kind string, holder string, utxo string, "
    "lovelace long, is_default boolean, datum string"
)


def random_ledger(n: int, names: int, seed: int, late: float = 0.3, repeat: float = 0.15):
    rnd = random.Random(seed)
    rows, utxos = [], [f"u{i}" for i in range(4)]
    kinds = ["mint", "mint", "transfer", "reference", "virtual", "settings", "burn", "burn"]
    for seq in range(n):
        slot = seq * 10 - (rnd.randrange(10, 400) if rnd.random() < late else 0)
        utxo = rnd.choice(utxos) if rnd.random() < repeat else f"t{seq}"
        # the first name takes a third of all rows
        name = "n0" if rnd.random() < 0.34 else f"n{rnd.randrange(names)}"
        datum = None if rnd.random() < 0.15 else f"d{seq}"
        rows.append(
            (seq, name, slot, rnd.choice(kinds), f"s{rnd.randrange(5)}", utxo, seq, rnd.random() < 0.4, datum)
        )
    return rows


def walk(rows):
    """The rules, one dict per asset; yields (seq, accepted, saved, state after)."""
    assets, out = {}, {}
    for seq, name, slot, kind, holder, utxo, lovelace, _, datum in rows:
        a = assets.get(name)
        accepted = saved = False
        late = a is not None and slot < a["updated"]
        needs = kind in ("reference", "virtual", "settings")
        if kind == "burn":
            if a:
                accepted = saved = True
                if a["amount"] > 1:
                    a = dict(a, amount=a["amount"] - 1)
                else:
                    a = None
        elif late:
            saved = True
            if kind == "mint":
                a = dict(a, created=min(a["created"], slot))
        elif needs and datum is None:
            pass
        elif kind == "settings" and a is None:
            pass
        else:
            accepted = saved = True
            had = a is not None
            a = dict(a) if had else {
                "amount": 1, "created": slot, "life": seq, "utxo": "", "holder": "", "lovelace": 0,
                "datum": None, "ref": None, "set": None,
            }
            a["updated"] = slot
            if kind in ("mint", "transfer"):
                if kind == "mint" and had and a["utxo"] and a["utxo"] != utxo:
                    a["amount"] += 1
                a.update(utxo=utxo, holder=holder, lovelace=lovelace, datum=datum)
            if kind == "virtual":
                a.update(utxo=utxo, holder=holder)
            if kind in ("reference", "virtual"):
                a["ref"] = seq
            if kind == "settings":
                a["set"] = seq
        assets[name] = a
        out[seq] = (accepted, saved, a)
    return out


def flat(a):
    if a is None:
        return (None,) * 10
    keys = ("amount", "updated", "created", "life", "utxo", "holder", "lovelace", "datum", "ref", "set")
    return tuple(a[k] for k in keys)
