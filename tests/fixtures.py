"""Contracts and sources retyped from the blueprint's fixture list."""

from pactum.types import Contract, Rule

EMAIL = r"^[^@]+@[^@]+\.[^@]+$"

C1 = Contract("customer_profile_contract", [
    Rule("customer_id", "long", True), Rule("email", "string", True), Rule("signup_ts", "timestamp", True),
    Rule("country", "string"),
], "1.0.0")
C2 = Contract("customers_contract", [
    Rule("customer_id", "long", True), Rule("email", "string", True, pattern=EMAIL),
    Rule("birth_date", "date", True, format="%Y-%m-%d"), Rule("amount", "double", True, min_value="0"),
], "1.0.0")
C3 = Contract("supplier_payment_contract", [
    Rule("customer_id", "long", True), Rule("email", "string", True, pattern=EMAIL),
    Rule("birth_date", "date", True, format="%Y-%m-%d"), Rule("amount", "decimal", True),
], "1.0.0")
C4 = Contract("example contract", [Rule("id", "integer"), Rule("name", "string")], "1.0")

F1 = [("customer_id", "string"), ("email", "string"), ("created_at", "timestamp"), ("marketing_opt_in", "boolean")]
F5 = [("id", "integer"), ("name", "string")]

_REPEATED = ("customer_id", "mail", "birth_date", "amount")
_F2 = [
    ("", "test@gmail.com", "01/01/1990", "25.5"), ("", "second@gmail.com", "1990-01-02", "-3"),
    ("789", "third@gmail.com", "1990-02-03", "-1"),
]
F2 = [*_F2, _REPEATED, *_F2]
_F3 = [("123", "test@gmail.com", "01/01/1990", "25.5"), ("124", "invalid-email", "1991-02-03", "not-a-number")]
F3 = [*_F3, _REPEATED, *_F3]
F4 = [
    ("1001", "alice@example.com", "2026-05-17T10:00:00Z", "true"),
    ("1002", "bob@example.com", "2026-05-17T11:00:00Z", "false"),
]


def rows_frame(spark, rows, columns):
    schema = "row long, " + ", ".join(f"{c} string" for c in columns)
    return spark.createDataFrame([(n + 2, *row) for n, row in enumerate(rows)], schema)
