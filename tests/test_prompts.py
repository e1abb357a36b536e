"""The rendered prompts against a plain rendering of every record that the generator keeps."""

from wardstream.operators import records
from wardstream.plans import catalogue

SF = "/root/testdata/sf0.001"


def rendered(r):
    port = lambda ip, p: f"{ip}:{p}" if p else ip
    some = lambda *pairs: [text for there, text in pairs if there]
    cat = r.attack_category
    title = f"{cat.replace('_', ' ').title()} Activity Detected" if cat and cat != "none" else f"Suspicious Process: {r.process_name}" if r.process_name else f"Network Activity: {r.src_ip} → {r.dst_ip}" if r.src_ip and r.dst_ip else "Security Event Detected"
    lines = ["## Security Alert for Triage", "", f"**Alert**: {title}", f"**Severity**: {r.severity or 'medium'}", f"**Source**: {r.source}"]
    lines += some((r.timestamp, f"**Timestamp**: {r.timestamp}")) + ["", "### Context"]
    lines += some((r.hostname, f"- **Hostname**: {r.hostname}"), (r.username, f"- **Username**: {r.username}"), (r.src_ip, f"- **Source IP**: {r.src_ip}"), (r.dst_ip, f"- **Destination IP**: {r.dst_ip}"))
    lines += ["", "### Evidence", f"**[EVT-{r.record_index + 1:06d}]** Network flow record:"]
    lines += some((r.src_ip, f"  Source: {port(r.src_ip, r.src_port)}"), (r.dst_ip, f"  Destination: {port(r.dst_ip, r.dst_port)}"), (r.protocol, f"  Protocol: {r.protocol}"), (r.duration is not None, f"  Duration: {r.duration}s"))
    lines += some((r.bytes_sent is not None, f"  Bytes sent: {r.bytes_sent}"), (r.bytes_recv is not None, f"  Bytes received: {r.bytes_recv}"), (r.process_name, f"  Process: {r.process_name}"), (r.command_line, f"  Command: {r.command_line}"), (r.file_path, f"  File: {r.file_path}"), (r.file_hash, f"  Hash: {r.file_hash}"))
    if r.mitre_technique_id:
        lines += ["", f"**MITRE ATT&CK**: {r.mitre_technique_id}"] + some((r.mitre_technique_name, f"  Technique: {r.mitre_technique_name}"), (r.mitre_tactic, f"  Tactic: {r.mitre_tactic}"))
    return "\n".join(lines)


def test_whole_prompts_of_kept_records(spark):
    rows = records.run_pipeline(catalogue.flows(spark, SF), records.label_map(spark), harmonize_first=True).collect()
    want = {r.record_id: rendered(r) for r in rows if r.classification not in (None, "review_required")}
    got = {r.record_id: r.prompt for r in catalogue.QUERIES["prompt_texts"](spark, SF).collect()}
    assert got == want and any("**MITRE ATT&CK**" in p for p in got.values())
