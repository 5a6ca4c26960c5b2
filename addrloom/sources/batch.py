"""Uploaded address lists: which column holds the address, which the id."""

from __future__ import annotations

import re

from .files import column_letters, decode, sheet_rows

MOST_ADDRESSES = 20_000
ADDRESS_NAMES = ("address", "full address", "input address", "street address", "query address", "mailing address", "property address", "site address", "situs address")
ID_NAMES = ("id", "query id", "record id", "row id", "address id", "parcel id", "customer id", "account id")


def _plain(name: str) -> str:
    return " ".join(re.sub("[^a-z0-9]+", " ", name.lower().replace("﻿", "")).split())


def upload_rows(name: str, content: bytes) -> list[list[str]]:
    """Rows of a CSV or XLSX upload; blank rows are left out."""
    import csv
    import io

    suffix = name.lower().rpartition(".")[2] if "." in name else "csv"
    if suffix not in ("csv", "xlsx"):
        raise ValueError("upload a .csv or .xlsx file")
    rows = sheet_rows(content) if suffix == "xlsx" else list(csv.reader(io.StringIO(decode(content), newline="")))
    return [r for r in rows if any(x.strip() for x in r)]


def _named(cell: str, names: tuple[str, ...], ending: str) -> bool:
    text = _plain(cell)
    return text in names or text.endswith(" " + ending)


def is_header(row: list[str]) -> bool:
    return any(_named(x, ADDRESS_NAMES, "address") or _named(x, ID_NAMES, "id") for x in row)


def find_column(header: list[str], asked: str, names: tuple[str, ...], ending: str, fallback: int | None) -> int | None:
    """Column by the name asked for, its letter or its number from 1; else by usual names; else the fallback."""
    asked = asked.strip()
    if asked:
        for i, cell in enumerate(header):
            if _plain(cell) == _plain(asked):
                return i
        at = int(asked) - 1 if asked.isdigit() else None
        if at is None and re.fullmatch("[A-Za-z]{1,2}", asked):
            at = next(i for i in range(800) if column_letters(i) == asked.upper())
        if at is not None and 0 <= at < len(header):
            return at
        raise ValueError(f"no column {asked!r}")
    exact = [i for i, x in enumerate(header) if _plain(x) in names]
    near = [i for i, x in enumerate(header) if _named(x, names, ending)]
    return (exact or near or [fallback])[0]


def addresses(rows: list[list[str]], address: str = "", id_: str = "", has_header: bool | None = None) -> list[tuple[int, str, str]]:
    """(row number from 1, id, address) of rows with an address; over 20,000 is an error."""
    if not rows:
        raise ValueError("the file is empty")
    header = is_header(rows[0]) if has_header is None else has_header
    column = find_column(rows[0], address, ADDRESS_NAMES if header else (), "address", 0)
    id_column = find_column(rows[0], id_, ID_NAMES if header else (), "id", None)
    cell = lambda r, i: r[i].strip() if i is not None and i < len(r) else ""
    out = [(k, cell(r, id_column), cell(r, column)) for k, r in enumerate(rows, 1) if k > header and cell(r, column)]
    if not out:
        raise ValueError("no addresses in the file")
    if len(out) > MOST_ADDRESSES:
        raise ValueError(f"more than {MOST_ADDRESSES} addresses")
    return out


def inspect(rows: list[list[str]]) -> dict:
    """Columns by letter with their names and first values, and the guesses."""
    width = max(map(len, rows), default=0)
    header = bool(rows) and is_header(rows[0])
    sample = rows[header : header + 10]
    first = lambda i: next((r[i].strip() for r in sample if i < len(r) and r[i].strip()), "")
    columns = [{"index": i, "letter": column_letters(i), "name": rows[0][i].strip() if header and i < len(rows[0]) else "", "sample": first(i)} for i in range(width)]
    return {"has_header": header, "columns": columns, "address_column": find_column(rows[0], "", ADDRESS_NAMES, "address", 0) if rows else None, "id_column": find_column(rows[0], "", ID_NAMES, "id", None) if header else None}
