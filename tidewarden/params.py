"""Tunable limits of the detectors, the ban ledger and the reports."""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class Params:
    """All durations are whole seconds."""

    # request-rate and subdomain detectors
    rate_limit_max_requests: int = 30
    rate_limit_window: int = 60
    check_interval: int = 10
    subdomain_flood_enabled: bool = True
    subdomain_flood_max_unique: int = 50
    subdomain_flood_window: int = 60
    watchlist_enabled: bool = False
    watchlist: tuple[str, ...] = ()

    # ban ledger
    ban_duration: int = 3600
    dry_run: bool = False
    whitelist: tuple[str, ...] = ()
    progressive_enabled: bool = True
    progressive_multiplier: int = 2
    progressive_max_level: int = 5
    progressive_reset_after: int = 86400
    sweep_lag: int = 0

    # external block list
    blocklist_duration: int = 0
    blocklist_auto_unban: bool = True
    blocklist_notify: bool = False

    # country policy
    geoip_enabled: bool = False
    geoip_mode: str = "blocklist"
    geoip_countries: tuple[str, ...] = ()
    geoip_notify: bool = True
    geoip_skip_private: bool = True
    geoip_cache_ttl: int = 86400

    # alerts
    notify_enabled: bool = True
    notify_type: str = "generic"
    product_name: str = "DNS Guard"
    project_url: str = "https://example.invalid/dns-guard"
    host_name: str = "unbekannt"
    abuse_enabled: bool = False
    abuse_categories: str = "4"

    # reports
    report_interval: str = "weekly"
    report_busiest_day_range: int = 30

    # physical layout: longest time slice one task has to order for one key, and the rows
    # above which a slice is ordered in finer cells
    max_slice_seconds: int = 3600
    max_slice_rows: int = 1_000_000

    def __post_init__(self) -> None:
        codes = tuple(c.strip().upper() for c in self.geoip_countries if c.strip())
        object.__setattr__(self, "geoip_countries", codes)

    def with_(self, **changes) -> "Params":
        return replace(self, **changes)

    @property
    def retention(self) -> int:
        """Seconds an event stays relevant; also the stream watermark delay."""
        return max(self.rate_limit_window, self.subdomain_flood_window) + 30
