"""Two small tables with known profiles."""

from datetime import date

CUSTOMER = "customer_id bigint, status string, gender string, age int, phone string, create_date date, source_system string, note bigint, payload bigint, optional_code string"
ORDERS = "order_id bigint, customer_id bigint, gender string, order_status string"


def gender(i):
    return "U" if i % 3 == 0 else "F" if i % 2 == 0 else "M"


def customers():
    for i in range(1, 201):
        status = {197: " active ", 198: "Active"}.get(i) or ("PENDING" if i % 10 == 0 else "INACTIVE" if i % 3 == 0 else "ACTIVE")
        age = {1: -1, 2: 150}.get(i, 18 + i % 60)
        phone = "138-1234-5678" if i == 199 else f"138{i:08d}"
        code = {1: None, 2: "", 3: "NULL"}[i] if i <= 3 else f"C{i % 4}"
        yield i, status, gender(i), age, phone, date(2099, 12, 31) if i == 200 else date(2026, 9, 15), "CRM", 100 + i, 2048 + i, code


def orders():
    for i in range(1, 121):
        yield 10_000 + i, i, gender(i), "CANCELLED" if i % 5 == 0 else "DONE" if i % 2 == 0 else "WAITING"


#: The two LOB columns are handed over as lengths, as a database would.
LOBS = {"NOTE": "CLOB", "PAYLOAD": "BLOB"}
