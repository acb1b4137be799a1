"""Registry rows from folded states: what is built once, what is overwritten, what stays."""

import json

import pytest
from ledgers import SCHEMA

from rollbook.operators import fold, registry

WHOLE = f"{SCHEMA}, built string, script string"


def datum(og, virtual=False, **project):
    own = {"name": "x", "image": f"ipfs://{og}", "og_number": og}
    if virtual:
        project |= {"virtual": {"expires_time": 5, "public_mint": 1}, "resolved_addresses": {"ada": "0xabc", "btc": "b1"}}
    return json.dumps({"constructor_0": [own, 1, {"image_hash": "0x1", "default": 1, **project}]})


def built(hex_name, image=None):
    return json.dumps({"hex": hex_name, "policy": "pol0", "image": image, "version": 2})


def event(seq, name, kind, text=None, made=None, script=None):
    return (seq, name, 10 * seq, kind, f"addr{seq}", f"t{seq}#{seq}", seq, False, text, made, script)


ROWS = [
    event(0, "a", "mint", made=built("000de14061", "ipfs://m"), script='{"type":"plutus_v2","cbor":"c0"}'),
    event(1, "a", "reference", datum(7, resolved_addresses={"eth": "e1"})),
    event(2, "a", "reference", '{"other": 1}', made=built("nothing")),
    event(3, "a", "settings", "[[1,1],[],9]"),
    event(4, "plain", "mint", made=built("706c61696e")),
    event(5, "v@r", "virtual", datum(3, virtual=True), made=built("00000000764072")),
    event(6, "v@r", "reference", datum(4)),
    event(7, "bare", "reference", '{"other": 1}', made=built("000de14062617265")),
]


@pytest.fixture(scope="module", params=[1 << 20, 2])
def rows(spark, request):
    """Folded at once, and in chunks of two rows."""
    ledger = spark.createDataFrame(ROWS, WHOLE)
    state = fold.current_state(fold.annotate(ledger, request.param, whole=True))
    return {r["name"]: r.asDict(recursive=True) for r in registry.from_state(state).collect()}


def test_an_invalid_datum_leaves_the_attributes(rows):
    a = rows["a"]
    assert (a["og_number"], a["image"], a["image_hash"], a["is_default"]) == (7, "ipfs://7", "0x1", True)
    assert a["reference_token"] == {"tx_id": "t2", "index": 2, "lovelace": 2, "datum": '{"other": 1}', "address": "addr2"}
    assert a["resolved_addresses"] == {"ada": "addr0"}  # those of the invalid datum: none
    assert a["updated_slot"] == 30 and a["script"] == {"type": "plutus_v2", "cbor": "c0"}


def test_rows_are_built_once(rows):
    assert [rows[n]["hex"] for n in ("a", "plain", "v@r", "bare")] == ["000de14061", "706c61696e", "00000000764072", "000de14062617265"]
    plain = rows["plain"]
    assert (plain["og_number"], plain["image"], plain["svg_version"], plain["policy"], plain["version"]) == (0, "", "0", "pol0", 2)
    assert plain["pz_enabled"] is None and plain["reference_token"] is None and plain["settings"] is None and plain["script"] is None
    assert rows["bare"]["utxo"] == "" and rows["bare"]["reference_token"]["tx_id"] == "t7"


def test_settings_keep_their_output(rows):
    settings = rows["a"]["settings"]
    assert settings["nft"]["public_minting_enabled"] == "1" and settings["buy_down_price"] == "9"
    assert settings["utxo"] == {"tx_id": "t3", "index": 3, "lovelace": 3, "datum": "[[1,1],[],9]", "address": "addr3"}


def test_a_virtual_asset_stays_one(rows):
    v = rows["v@r"]
    assert v["asset_type"] == "virtual_subhandle" and v["virtual"] == {"expires_time": 5, "public_mint": True}
    assert v["og_number"] == 4 and v["utxo"] == "t5#5"  # the later reference event overwrites attributes only
    assert v["resolved_addresses"]["ada"] == "addr5"
