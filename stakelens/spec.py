"""What differs between networks, as data.

The metrics are the same everywhere; a network only changes the inputs they read
and a few constants.
"""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class AttributeLeg:
    """One way a message moves stake: which amounts go to which validator.

    No amount key may also be a validator key.
    """

    msg_type: str
    amount_keys: tuple[str, ...]
    validator_key: str
    sign: int


def _attribute_legs(
    unbond_keys: tuple[str, ...], delegate_keys: tuple[str, ...]
) -> tuple[AttributeLeg, ...]:
    return (
        AttributeLeg("unbond", unbond_keys, "validator", -1),
        AttributeLeg("delegate", delegate_keys, "validator", 1),
        AttributeLeg("redelegate", ("amount",), "source_validator", -1),
        AttributeLeg("redelegate", ("amount",), "destination_validator", 1),
    )


@dataclass(frozen=True)
class ChainSpec:
    """Settings of one network.

    ``staking`` is ``"typed"`` (one row per staking action) or ``"attributes"``
    (raw key/value message attributes). ``positive_only`` drops validators whose
    cumulative stake is not above zero from both ranking and totals.
    ``nakamoto_inbound_denom`` filters only the inbound half of a redelegation,
    and only for the Nakamoto coefficient; ``None`` means the network's own denom.
    ``variant`` keeps the gold tables of a differing spec of one network apart.
    """

    name: str
    staking: str
    grain: str
    positive_only: bool
    power_pct: int
    nakamoto_pct: int
    last_band: str
    denom: str | None = None
    nakamoto_inbound_denom: str | None = None
    power_legs: tuple[AttributeLeg, ...] = ()
    nakamoto_legs: tuple[AttributeLeg, ...] = ()
    proposals_from: str = "deposits"
    newcomer: str = "delegator"
    wallet_column: str = "tx_from"
    variant: str = ""

    @property
    def label(self) -> str:
        return f"{self.name}_{self.variant}" if self.variant else self.name

    @property
    def nakamoto_differs(self) -> bool:
        """Whether the Nakamoto coefficient needs stake flows of its own."""
        return self.power_legs != self.nakamoto_legs or self.nakamoto_inbound_denom not in (
            None,
            self.denom,
        )


# Thresholds, denominations, band labels and amount keys per network.
OSMOSIS = ChainSpec(
    name="osmosis",
    staking="typed",
    grain="day",
    positive_only=False,
    power_pct=66,
    nakamoto_pct=35,
    last_band="3. Top +50 validators",
    denom="uosmo",
    newcomer="validator",
)
COSMOS = ChainSpec(
    name="cosmos",
    staking="attributes",
    grain="month",
    positive_only=True,
    power_pct=33,
    nakamoto_pct=33,
    last_band="3. Top 50-100 validators",
    power_legs=_attribute_legs(("amount",), ("new_shares", "amount")),
    nakamoto_legs=_attribute_legs(("new_shares", "amount"), ("amount",)),
)
TERRA = ChainSpec(
    name="terra",
    staking="attributes",
    grain="month",
    positive_only=True,
    power_pct=33,
    nakamoto_pct=50,
    last_band="3. Top 50-100 validators",
    power_legs=_attribute_legs(("amount",), ("new_shares", "amount")),
    nakamoto_legs=_attribute_legs(("amount",), ("new_shares", "amount")),
    proposals_from="votes",
    wallet_column="tx_sender",
)
AXELAR = ChainSpec(
    name="axelar",
    staking="typed",
    grain="day",
    positive_only=False,
    power_pct=66,
    nakamoto_pct=35,
    last_band="3. Top +50 validators",
    denom="uaxl",
)
# Axelar's Nakamoto query was published with another network's denom on the
# inbound redelegation leg, so that leg matches nothing.
AXELAR_AS_PUBLISHED = replace(AXELAR, nakamoto_inbound_denom="uosmo", variant="as_published")

PRESETS = {s.label: s for s in (OSMOSIS, COSMOS, TERRA, AXELAR, AXELAR_AS_PUBLISHED)}
