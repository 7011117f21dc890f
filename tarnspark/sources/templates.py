"""Sixteen fixed requests, for warm-up and golden tests."""

from __future__ import annotations

import json

# Fixed values, a request a row: requested at, last transaction at (none: null), amount, installments, customer's average,
# transactions in 24 hours, first and number of known merchants, merchant, category, merchant's average, online, card
# present, km from home, km from the last transaction.
REQUESTS = (
    ("2026-03-01T09:23:35Z", None, 41.12, 1, 82.24, 1, 1, 2, "MERC-001", "5411", 55.10, False, True, 2.7, 0.0),
    ("2026-07-18T16:12:04Z", "2023-04-21T08:11:02Z", 288.45, 2, 410.12, 3, 4, 4, "MERC-006", "5812", 302.78, True, False, 18.4, 8.2),
    ("2027-02-09T11:44:19Z", "2026-12-29T15:39:44Z", 476.90, 3, 953.80, 5, 7, 5, "MERC-011", "5912", 488.45, False, True, 47.6, 12.6),
    ("2027-10-27T19:51:02Z", "2022-10-05T13:27:19Z", 123.34, 1, 232.10, 2, 10, 3, "MERC-012", "5311", 140.00, False, True, 6.1, 19.7),
    ("2028-01-14T02:08:43Z", "2019-03-08T01:41:03Z", 7340.10, 8, 123.55, 8, 2, 2, "MERC-050", "7995", 31.70, True, False, 920.3, 811.3),
    ("2028-06-03T05:37:10Z", None, 9505.97, 10, 88.91, 19, 5, 5, "MERC-088", "7801", 74.25, True, False, 403.7, 452.9),
    ("2028-12-22T00:19:58Z", "2020-12-17T20:22:50Z", 2218.55, 6, 245.40, 12, 8, 4, "MERC-063", "7802", 93.80, True, False, 281.4, 278.4),
    ("2029-04-11T06:45:31Z", "2024-06-03T05:18:12Z", 6682.32, 12, 174.20, 15, 11, 3, "MERC-097", "7995", 45.55, False, True, 765.2, 923.6),
    ("2029-09-28T03:02:17Z", "2016-08-30T23:59:58Z", 4890.71, 7, 298.73, 10, 14, 5, "MERC-074", "7801", 88.40, True, False, 612.8, 554.1),
    ("2030-01-06T14:26:50Z", "2028-11-19T11:02:45Z", 510.40, 3, 340.00, 4, 3, 2, "MERC-031", "5944", 120.10, False, True, 55.1, 31.5),
    ("2030-05-19T20:05:13Z", None, 1840.25, 5, 208.65, 9, 6, 4, "MERC-047", "4511", 211.35, True, False, 288.9, 118.2),
    ("2030-12-28T18:39:44Z", "2026-01-14T17:09:32Z", 2990.99, 7, 455.35, 11, 9, 5, "MERC-059", "5999", 285.70, False, True, 397.5, 260.4),
    ("2026-11-07T10:17:25Z", "2021-07-01T07:26:54Z", 395.00, 3, 700.20, 5, 12, 3, "MERC-014", "5411", 430.80, False, True, 22.0, 5.5),
    ("2027-05-16T22:48:07Z", "2025-05-16T21:48:07Z", 430.50, 4, 112.00, 6, 15, 4, "MERC-038", "7802", 150.00, True, False, 84.6, 74.0),
    ("2029-02-24T13:59:36Z", "2028-02-22T13:59:36Z", 2760.80, 6, 280.50, 18, 17, 2, "MERC-091", "7995", 62.95, True, False, 948.4, 875.2),
    ("2030-08-12T04:31:21Z", "2027-09-12T04:31:21Z", 2450.65, 5, 430.15, 7, 1, 5, "MERC-055", "5944", 240.20, True, False, 331.6, 210.9),
)
KNOWN_MERCHANTS = 19


def bodies() -> list[str]:
    out = []
    for k, (at, last, amount, installments, average, count, first, known, merchant, mcc, merchant_average, online, card, home, current) in enumerate(REQUESTS):
        request = {
            "id": f"tx-warmup-{k:04d}",
            "transaction": {"amount": amount, "installments": installments, "requested_at": at},
            "customer": {"avg_amount": average, "tx_count_24h": count, "known_merchants": [f"MERC-{(first + j - 1) % KNOWN_MERCHANTS + 1:03d}" for j in range(known)]},
            "merchant": {"id": merchant, "mcc": mcc, "avg_amount": merchant_average},
            "terminal": {"is_online": online, "card_present": card, "km_from_home": home},
            "last_transaction": last and {"timestamp": last, "km_from_current": current},
        }
        out.append(json.dumps(request, separators=(",", ":")))
    return out
