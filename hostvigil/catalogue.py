"""The feature catalogue, layers, rules and incident texts as data."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# Layers in order of attribution.
LAYERS = ["wifi", "os", "dns", "gateway", "path", "remote_https", "vpn"]
# Name, layer, unit, higher is worse, categorical, least and largest value.
FEATURES: list[tuple[str, str, str, bool, bool, float | None, float | None]] = [
    ("os_iface_type", "os", "enum", False, True, None, None),
    ("os_link_mbps", "os", "Mbit/s", False, False, None, None),
    ("os_rx_drop_rate", "os", "fraction", True, False, 0.0, 1.0),
    ("os_tx_drop_rate", "os", "fraction", True, False, 0.0, 1.0),
    ("os_tx_err_rate", "os", "fraction", True, False, 0.0, 1.0),
    ("os_retrans_rate", "os", "fraction", True, False, 0.0, 1.0),
    ("os_cpu_pct", "os", "percent", True, False, 0.0, 100.0),
    ("os_mem_pct", "os", "percent", True, False, 0.0, 100.0),
    ("os_on_battery", "os", "bool", False, True, None, None),
    ("vpn_active", "vpn", "bool", False, True, None, None),
    ("vpn_mtu", "vpn", "bytes", False, False, None, None),
    ("wifi_rssi_dbm", "wifi", "dBm", False, False, -100.0, 0.0),
    ("wifi_signal_pct", "wifi", "percent", False, False, 0.0, 100.0),
    ("wifi_link_mbps", "wifi", "Mbit/s", False, False, None, None),
    ("wifi_tx_retry_rate", "wifi", "fraction", True, False, 0.0, 1.0),
    ("wifi_noise_dbm", "wifi", "dBm", True, False, -120.0, 0.0),
    ("wifi_channel", "wifi", "enum", False, True, None, None),
    ("wifi_band_ghz", "wifi", "GHz", False, False, None, None),
    ("wifi_roam_count", "wifi", "count", True, False, None, None),
    ("dns_p50_ms", "dns", "ms", True, False, None, None),
    ("dns_p95_ms", "dns", "ms", True, False, None, None),
    ("dns_fail_rate", "dns", "fraction", True, False, 0.0, 1.0),
    ("gw_rtt_ms", "gateway", "ms", True, False, None, None),
    ("gw_jitter_ms", "gateway", "ms", True, False, None, None),
    ("gw_loss_rate", "gateway", "fraction", True, False, 0.0, 1.0),
    ("path_hops", "path", "count", False, False, None, None),
    ("path_rtt_ms", "path", "ms", True, False, None, None),
    ("path_second_hop_ms", "path", "ms", True, False, None, None),
    ("path_unresponsive_rate", "path", "fraction", True, False, 0.0, 1.0),
    ("path_changed", "path", "bool", True, True, None, None),
    ("https_dns_ms", "remote_https", "ms", True, False, None, None),
    ("https_tcp_ms", "remote_https", "ms", True, False, None, None),
    ("https_tls_ms", "remote_https", "ms", True, False, None, None),
    ("https_ttfb_ms", "remote_https", "ms", True, False, None, None),
    ("https_total_ms", "remote_https", "ms", True, False, None, None),
    ("https_fail_rate", "remote_https", "fraction", True, False, 0.0, 1.0),
    ("captive_portal", "context", "bool", True, True, None, None),
    ("hour_of_day", "context", "hour", False, True, None, None),
    ("day_of_week", "context", "day", False, True, None, None),
]
NAMES = [f[0] for f in FEATURES]
LAYER_OF = {f[0]: f[1] for f in FEATURES}
WORSE_UP = {f[0]: f[3] for f in FEATURES}
CONTEXT = {f[0] for f in FEATURES if f[1] == "context"} | {"os_on_battery"}
MODELLED = [f[0] for f in FEATURES if not f[4] and f[0] not in CONTEXT]
#: Layers with enough modelled features for an autoencoder.
BUNDLES = {layer: [f for f in MODELLED if LAYER_OF[f] == layer] for layer in LAYERS if sum(LAYER_OF[f] == layer for f in MODELLED) >= 2}
# Seconds after which a carried value is stale.
STALENESS = {"path": 2400, "context": 1200, "remote_https": 420, "dns": 240, "wifi": 120, "gateway": 120, "os": 120, "vpn": 120}
# Ratios between layers, in the order of the model's inputs, and the features whose trends the model reads.
DERIVED = ["x_remote_over_gateway", "x_path_minus_gateway_ms", "x_remote_minus_path_ms", "x_dns_share", "x_tls_share", "x_wifi_weakness", "x_wifi_pressure", "x_link_headroom", "x_failure_pressure", "x_failure_breadth"]
TRENDS = ["gw_rtt_ms", "gw_jitter_ms", "gw_loss_rate", "dns_p50_ms", "dns_fail_rate", "https_ttfb_ms", "https_tls_ms", "https_fail_rate", "path_rtt_ms", "wifi_rssi_dbm", "wifi_tx_retry_rate", "os_retrans_rate"]
SEVERITIES = ["info", "watch", "risk", "critical"]


@dataclass(frozen=True)
class Rule:
    """A threshold rule: SQL condition, layer (SQL), severity, risk floor, layers that it silences."""

    id: str
    condition: str
    layer: str
    severity: str
    floor: float = 0.0
    suppresses: tuple[str, ...] = ()


# Rules in order; of each pair with the same feature at most one fires.
RULES = [
    Rule("captive_portal", "captive_portal >= 1", "'dns'", "critical", 0.9, ("path", "remote_https", "dns", "gateway", "wifi", "os", "vpn")),
    Rule("gateway_unreachable", "gw_loss_rate >= 0.99", "'gateway'", "critical", 0.95, ("path", "remote_https", "dns")),
    Rule("gateway_loss", "gw_loss_rate >= 0.5 AND gw_loss_rate < 0.99", "'gateway'", "risk", 0.7),
    Rule("dns_blackhole", "dns_fail_rate >= 0.99", "'dns'", "critical", 0.9, ("remote_https",)),
    Rule("dns_failures", "dns_fail_rate >= 0.34 AND dns_fail_rate < 0.99", "'dns'", "risk", 0.6),
    Rule("remote_unreachable", "https_fail_rate >= 0.99 AND coalesce(gw_loss_rate < 0.5, true) AND coalesce(dns_fail_rate < 0.2, true)", "'remote_https'", "critical", 0.9),
    Rule("wifi_signal_floor", "wifi_rssi_dbm <= -82", "'wifi'", "risk", 0.55),
    Rule("wifi_signal_weak", "wifi_rssi_dbm <= -75 AND wifi_rssi_dbm > -82", "'wifi'", "watch"),
    Rule("wifi_retries", "wifi_tx_retry_rate >= 0.35", "'wifi'", "risk", 0.55),
    Rule("tcp_retransmissions", "os_retrans_rate >= 0.08", "CASE WHEN coalesce(vpn_active, 0) >= 1 THEN 'vpn' ELSE 'os' END", "watch"),
]

# Template, layer, specificity, SQL condition, remediations. Texts are in TEXTS.
TEMPLATES: list[tuple[str, str, int, str, tuple[str, ...]]] = [
    ("wifi.signal_floor", "wifi", 3, "coalesce(wifi_rssi_dbm, 0) <= -75", ("move_closer", "switch_band", "use_ethernet")),
    ("wifi.interference", "wifi", 4, "coalesce(wifi_tx_retry_rate, 0) >= 0.15 AND coalesce(wifi_rssi_dbm, -100) > -70", ("switch_band", "change_channel", "use_ethernet")),
    ("wifi.crowded_24", "wifi", 5, "coalesce(wifi_band_ghz, 5) < 3 AND coalesce(wifi_tx_retry_rate, 0) >= 0.12", ("switch_band", "change_channel", "move_closer")),
    ("wifi.roaming", "wifi", 4, "coalesce(wifi_roam_count, 0) >= 1", ("move_closer", "use_ethernet", "forget_rejoin")),
    ("wifi.rate_collapse", "wifi", 2, "coalesce(wifi_link_mbps, 0) > 0 AND coalesce(wifi_link_mbps, 0) <= 54", ("move_closer", "switch_band", "forget_rejoin")),
    ("wifi.generic", "wifi", 0, "true", ("move_closer", "switch_band", "use_ethernet")),
    ("dns.captive_portal", "dns", 9, "coalesce(captive_portal, 0) >= 1", ("sign_in_portal", "wait_and_watch")),
    ("dns.failing", "dns", 5, "coalesce(dns_fail_rate, 0) >= 0.2", ("flush_dns", "change_resolver", "restart_gateway")),
    ("dns.slow", "dns", 1, "true", ("flush_dns", "change_resolver", "wait_and_watch")),
    ("gateway.unreachable", "gateway", 9, "coalesce(gw_loss_rate, 0) >= 0.99", ("check_cables", "restart_gateway", "wait_and_watch")),
    ("gateway.loss", "gateway", 5, "coalesce(gw_loss_rate, 0) >= 0.1", ("restart_gateway", "check_cables", "check_gateway_load")),
    ("gateway.congestion", "gateway", 1, "true", ("check_gateway_load", "restart_gateway", "use_ethernet")),
    ("path.reroute", "path", 5, "coalesce(path_changed, 0) >= 1", ("wait_and_watch", "contact_isp", "try_other_service")),
    ("path.isp_congestion", "path", 1, "true", ("wait_and_watch", "contact_isp", "use_ethernet")),
    ("remote.unreachable", "remote_https", 6, "coalesce(https_fail_rate, 0) >= 0.5", ("try_other_service", "check_service_status", "contact_isp")),
    ("remote.tls_slow", "remote_https", 4, "coalesce(https_tls_ms, 0) >= 250", ("try_other_service", "check_service_status", "wait_and_watch")),
    ("remote.service_slow", "remote_https", 1, "true", ("try_other_service", "check_service_status", "wait_and_watch")),
    ("vpn.overload", "vpn", 1, "true", ("test_without_vpn", "check_vpn_server", "wait_and_watch")),
    ("os.retransmissions", "os", 4, "coalesce(os_retrans_rate, 0) >= 0.05", ("restart_device_network", "update_adapter_driver", "close_heavy_apps")),
    ("os.resource_pressure", "os", 4, "coalesce(os_cpu_pct, 0) >= 75", ("close_heavy_apps", "wait_and_watch")),
    ("os.generic", "os", 0, "true", ("close_heavy_apps", "restart_device_network", "update_adapter_driver")),
]
#: Our own wording; {name} is a value of `incidents.RENDERED`.
TEXTS = {
    "wifi.signal_floor": "Weak radio signal: {rssi} dBm on a {link} Mbit/s link.",
    "wifi.interference": "Signal is good ({rssi} dBm) but {retries}% of frames repeat; the channel is busy.",
    "wifi.crowded_24": "On {band} GHz with {retries}% of frames repeated.",
    "wifi.roaming": "The host changed its access point.",
    "wifi.rate_collapse": "Radio link at {link} Mbit/s, signal {rssi} dBm.",
    "wifi.generic": "Radio quality is down: {rssi} dBm, {retries}% repeated.",
    "dns.captive_portal": "A sign-in page answers for every address.",
    "dns.failing": "{dns_fail}% of lookups fail.",
    "dns.slow": "Lookups take {dns_p50} ms.",
    "gateway.unreachable": "The router does not answer.",
    "gateway.loss": "{gw_loss}% of probes to the router are lost.",
    "gateway.congestion": "The router answers in {gw_rtt} ms, varying by {gw_jitter} ms.",
    "path.reroute": "A new route adds {path_extra} ms past the router.",
    "path.isp_congestion": "The router is fine ({gw_rtt} ms); the path takes {path_rtt} ms, {path_extra} of them past it.",
    "remote.unreachable": "{https_fail}% of test connections fail behind a working router.",
    "remote.tls_slow": "Secure handshakes take {tls} ms.",
    "remote.service_slow": "First bytes take {ttfb} ms, {remote_extra} ms more than the path.",
    "vpn.overload": "Time is lost in the tunnel: {retrans}% resent, {ttfb} ms to answer; next suspect: {secondary}.",
    "os.retransmissions": "The host resends {retrans}% of its segments.",
    "os.resource_pressure": "Processor at {cpu}%.",
    "os.generic": "The host itself changed (layer {layer}, risk {risk}%): processor {cpu}%, {retrans}% resent.",
}
#: Our own wording: the headline of each template.
TITLES = {
    "wifi.signal_floor": "Weak radio signal",
    "wifi.interference": "Busy radio channel",
    "wifi.crowded_24": "Crowded 2.4 GHz band",
    "wifi.roaming": "Access point changed",
    "wifi.rate_collapse": "Slow radio link",
    "wifi.generic": "Radio trouble",
    "dns.captive_portal": "Sign-in page in the way",
    "dns.failing": "Lookups fail",
    "dns.slow": "Lookups are slow",
    "gateway.unreachable": "Router silent",
    "gateway.loss": "Packets lost at the router",
    "gateway.congestion": "Router under load",
    "path.reroute": "Longer route",
    "path.isp_congestion": "Provider network slow",
    "remote.unreachable": "Services out of reach",
    "remote.tls_slow": "Slow handshakes",
    "remote.service_slow": "Slow services",
    "vpn.overload": "Tunnel overloaded",
    "os.retransmissions": "Many resent segments",
    "os.resource_pressure": "Host short of processor time",
    "os.generic": "Trouble on the host",
}
# Remediation ids in order; the texts are our own.
REMEDIATIONS = {
    "move_closer": "Go nearer to the access point.",
    "switch_band": "Use the 5 GHz band.",
    "change_channel": "Pick a free radio channel.",
    "use_ethernet": "Use a cable.",
    "forget_rejoin": "Leave the network and join it again.",
    "flush_dns": "Clear the resolver cache.",
    "change_resolver": "Use another resolver.",
    "sign_in_portal": "Sign in on the network page.",
    "restart_gateway": "Restart the router.",
    "check_gateway_load": "Look for large transfers in the local network.",
    "check_cables": "Check the router cables.",
    "wait_and_watch": "Wait; this often passes.",
    "contact_isp": "Report it to the provider.",
    "test_without_vpn": "Try without the tunnel.",
    "check_vpn_server": "Try another tunnel server.",
    "close_heavy_apps": "Close busy programs.",
    "restart_device_network": "Restart the network adapter.",
    "try_other_service": "Try another site.",
    "check_service_status": "Read the service status page.",
    "update_adapter_driver": "Update the adapter driver.",
}


def samples_schema() -> T.StructType:
    """host_id, ts and all features, null for absent."""
    return T.StructType([T.StructField("host_id", T.LongType()), T.StructField("ts", T.DoubleType()), *[T.StructField(n, T.DoubleType()) for n in NAMES]])


def feature_dim(spark: SparkSession) -> DataFrame:
    """The catalogue as a table of 39 rows."""
    return spark.createDataFrame(FEATURES, "feature string, layer string, unit string, worse_up boolean, categorical boolean, clip_min double, clip_max double")
