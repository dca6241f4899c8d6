"""Interface documents (IDL): model, names, hashing and small metadata tables.

An IDL is metadata, a few kilobytes per program, so it lives on the driver as
plain Python objects. Everything that scales with data is a DataFrame.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from typing import Any

from progscan.functions.codec import (
    DISC_PREFIX_ACCOUNT,
    DISC_PREFIX_EVENT,
    DISC_PREFIX_INSTRUCTION,
    canonical_json,
    discriminator_py,
    idl_hash_py,
    normalise_name_py,
    table_name_py,
)

# Field names of the classes' documents and the type names are fixed: they are the document format.
IdlType = Any  # str | {"vec": T} | {"option": T} | {"defined": name} | {"array": [T, n]}

SCALAR_TYPES = ("bool", "u8", "u16", "u32", "u64", "u128", "i8", "i16", "i32", "i64", "i128",
                "f32", "f64", "string", "publicKey")


@dataclass(frozen=True)
class Field:
    name: str
    type: IdlType


@dataclass(frozen=True)
class AccountMeta:
    name: str
    is_mut: bool = False
    is_signer: bool = False


@dataclass(frozen=True)
class Instruction:
    name: str
    accounts: tuple[AccountMeta, ...]
    args: tuple[Field, ...]

    @property
    def discriminator(self) -> str:
        return discriminator_py(DISC_PREFIX_INSTRUCTION, self.name)


@dataclass(frozen=True)
class StructDef:
    """Account type, event, or custom type with named fields."""
    name: str
    fields: tuple[Field, ...]
    kind: str = "struct"
    variants: tuple[str, ...] = ()
    variant_fields: tuple[tuple[Field, ...], ...] = ()


@dataclass
class Idl:
    name: str
    version: str | None
    instructions: tuple[Instruction, ...]
    accounts: tuple[StructDef, ...] = ()
    types: tuple[StructDef, ...] = ()
    events: tuple[StructDef, ...] = ()
    doc: dict = field(default_factory=dict, repr=False)

    # ------------------------------------------------------------ parsing --
    @classmethod
    def from_dict(cls, d: dict) -> "Idl":
        def fields(fs):
            return tuple(Field(f["name"], f["type"]) for f in (fs or []))

        def variant(fs):
            """Named fields, or plain types numbered from 0."""
            return tuple(Field(f["name"], f["type"]) if isinstance(f, dict) and "type" in f else Field(str(i), f)
                         for i, f in enumerate(fs or []))

        ixs = tuple(
            Instruction(
                ix["name"],
                tuple(AccountMeta(a["name"], bool(a.get("isMut", False)), bool(a.get("isSigner", False)))
                      for a in ix.get("accounts", [])),
                fields(ix.get("args", [])),
            )
            for ix in d.get("instructions", [])
        )
        accs = tuple(StructDef(a["name"], fields(a.get("type", {}).get("fields")))
                     for a in (d.get("accounts") or []))
        types = tuple(
            StructDef(t["name"], fields(t.get("type", {}).get("fields")), t.get("type", {}).get("kind", "struct"),
                      tuple(v["name"] for v in t.get("type", {}).get("variants", []) or []),
                      tuple(variant(v.get("fields")) for v in t.get("type", {}).get("variants", []) or []))
            for t in (d.get("types") or [])
        )
        evs = tuple(StructDef(e["name"], fields(e.get("fields"))) for e in (d.get("events") or []))
        return cls(d["name"], d.get("version"), ixs, accs, types, evs, doc=d)

    @classmethod
    def from_json(cls, text: str) -> "Idl":
        return cls.from_dict(json.loads(text))

    # ------------------------------------------------------------- naming --
    def instruction_table(self, ix_name: str) -> str:
        return table_name_py("ix", self.name, ix_name)

    def account_table(self, acc_name: str) -> str:
        return table_name_py("acc", self.name, acc_name)

    def history_table(self, acc_name: str) -> str:
        return table_name_py("acc_history", self.name, acc_name)

    @property
    def events_table(self) -> str:
        return normalise_name_py(f"{self.name}_events")

    # ------------------------------------------------------------ lookups --
    def instruction(self, name: str) -> Instruction:
        for ix in self.instructions:
            if ix.name == name:
                return ix
        raise KeyError(name)

    def account(self, name: str) -> StructDef:
        for a in self.accounts:
            if a.name == name:
                return a
        raise KeyError(name)

    def type_def(self, name: str) -> StructDef | None:
        for t in self.types:
            if t.name == name:
                return t
        return None

    @property
    def json_text(self) -> str:
        return canonical_json(self.doc)

    @property
    def hash(self) -> str:
        return idl_hash_py(self.doc)

    # --------------------------------------------------- discriminators ---
    def instruction_discriminators(self, name_case: str = "as_is") -> list[tuple[str, str]]:
        """(name, disc) pairs. ``name_case="snake"`` hashes the snake_case form of
        camelCase names (the usual on-chain convention, Q-3); default hashes as written."""
        conv = snake_case if name_case == "snake" else (lambda x: x)
        return [(ix.name, discriminator_py(DISC_PREFIX_INSTRUCTION, conv(ix.name))) for ix in self.instructions]

    def event_discriminators(self) -> list[tuple[str, str]]:
        return [(e.name, discriminator_py(DISC_PREFIX_EVENT, e.name)) for e in self.events]

    def account_discriminators(self) -> list[tuple[str, str]]:
        return [(a.name, discriminator_py(DISC_PREFIX_ACCOUNT, a.name)) for a in self.accounts]


def defined_name(t: dict) -> str:
    """The name in a ``defined`` type (written as text, or as an object with a name)."""
    return t["defined"] if isinstance(t["defined"], str) else t["defined"].get("name")


def snake_case(name: str) -> str:
    import re

    return re.sub(r"(?<=[a-z0-9])([A-Z])", r"_\1", name).lower()


def column_name(prefix: str, name: str) -> str:
    """Stored column for an account (``account_``) or argument (``arg_``) name."""
    return normalise_name_py(f"{prefix}{name}")


def type_label(t: IdlType) -> str:
    """Readable label of an IDL type, e.g. ``vec<u64>``."""
    if isinstance(t, str):
        return t
    if "vec" in t:
        return f"vec<{type_label(t['vec'])}>"
    if "option" in t:
        return f"option<{type_label(t['option'])}>"
    if "defined" in t:
        return f"defined<{defined_name(t)}>"
    if "array" in t:
        return f"array<{type_label(t['array'][0])},{t['array'][1]}>"
    return "unknown"
