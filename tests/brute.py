"""The metrics once more in plain Python, as loops over rows; for small inputs only."""

from collections import defaultdict
from decimal import ROUND_HALF_UP, Decimal, InvalidOperation


def legs_typed(rows, denom):
    """rows: (ts, tx, action, validator, source, amount, currency)."""
    legs = set()
    for ts, tx, action, validator, source, amount, currency in rows:
        if currency != denom or amount is None:
            continue
        if source is not None:
            legs.add((ts, tx, source, -amount))
            legs.add((ts, tx, validator, amount))
        else:
            legs.add((ts, tx, validator, -amount if action == "undelegate" else amount))
    return legs


def legs_attributes(rows, spec_legs):
    """rows: (ts, tx, msg_type, key, value). Every amount times every validator."""
    by_tx = defaultdict(list)
    for row in rows:
        by_tx[row[1]].append(row)
    legs = set()
    for tx, messages in by_tx.items():
        for leg in spec_legs:
            validators = [
                m[4] for m in messages if m[2] == leg.msg_type and m[3] == leg.validator_key
            ]
            for ts, _, msg_type, key, value in messages:
                if msg_type != leg.msg_type or key not in leg.amount_keys or value is None:
                    continue
                start = value.find("i") if "i" in value else value.find("u")
                if start < 0:
                    continue
                denom = value[start:]
                try:
                    micro = int(
                        Decimal(value.replace(denom, "")).quantize(
                            Decimal(1), rounding=ROUND_HALF_UP
                        )
                    )
                except InvalidOperation:
                    continue
                if micro < 10**15:
                    for validator in validators:
                        legs.add((ts, tx, validator, denom, leg.sign * micro))
    return legs


def power(legs, period, positive_only):
    """legs: (ts, ..., validator, ..., staked) reduced to (ts, validator, staked)."""
    flows = defaultdict(int)
    for ts, validator, staked in legs:
        flows[period(ts), validator] += staked
    cum, positions = defaultdict(int), []
    for (days, validator), flow in sorted(flows.items()):
        cum[validator] += flow
        if cum[validator] > 0 or not positive_only:
            positions.append((days, validator, flow, cum[validator]))
    total, running = {}, 0
    for days in sorted({p[0] for p in positions}):
        running += sum(p[2] for p in positions if p[0] == days)
        total[days] = running
    table = []
    for days, validator, _, stake in positions:
        above = [p[3] for p in positions if p[0] == days and p[3] >= stake]
        table.append((days, validator, stake, len(above), sum(above), total[days]))
    return table
