"""Explicit schemas of captures, documents, findings and scan observations."""

from __future__ import annotations

HEADERS = "array<struct<name:string,value:string>>"
EXCHANGE = (
    f"url string, method string, request_headers {HEADERS}, request_body string, status_code int, response_headers {HEADERS}, response_body string, "
    "timestamp string, response_rtt double, response_rtt_ms double, technologies array<string>, forms array<map<string,string>>"
)
KATANA = (
    "timestamp string, request struct<endpoint:string,method:string,headers:map<string,string>,body:string>, "
    "response struct<status_code:int,headers:map<string,string>,body:string,rtt:double,technologies:string,forms:array<map<string,string>>>"
)
HAR = (
    "log struct<entries:array<struct<startedDateTime:string,time:double,"
    "request:struct<method:string,url:string,headers:array<struct<name:string,value:string>>,content:struct<text:string>,postData:struct<text:string>>,"
    "response:struct<status:int,headers:array<struct<name:string,value:string>>,content:struct<mimeType:string,size:int,text:string>>>>>"
)
SCANNER = (
    "`template-id` string, `template-url` string, `template-path` string, type string, `matched-at` string, url string, host string, ip string, port string, scheme string, "
    "timestamp string, `matcher-name` string, `curl-command` string, request string, response string, `matcher-status` boolean, `extracted-results` string, "
    "info struct<name:string,severity:string,description:string,remediation:string,author:string,tags:string,reference:string,"
    "classification:struct<`cve-id`:string,`cwe-id`:string,`cvss-score`:string,`cvss-metrics`:string,`epss-score`:double,`epss-percentile`:double,cpe:string>,metadata:map<string,string>>"
)
SCAN_PORTS = "run_id string, ts timestamp, hostname string, ip_address string, netloc string, port int, state string, service_name string, service_notes string"
SCAN_RUNS = "run_id string, ts timestamp, targets string, ports string, has_error boolean"
#: Row versions that readers show.
WEB_RESOURCE_VERSION, FINDING_VERSION, SCAN_VERSION = 1, 1, 2
UNSPLIT = None
#: Token lengths of each document type (None: unsplit), and whether it uses the code model.
DOC_TYPES: dict[str, tuple[tuple[int | None, ...], bool]] = {
    "html": ((UNSPLIT, 256), True), "xml": ((UNSPLIT, 256), True), "javascript": ((UNSPLIT, 256), True), "json": ((UNSPLIT, 256), True),
    "css": ((UNSPLIT, 256), True), "network": ((UNSPLIT, 256), False), "finding": ((UNSPLIT, 256), False), "default": ((UNSPLIT, 256), False),
    "forms": ((256,), True), "nmap": ((UNSPLIT,), True), "portscan": ((UNSPLIT,), True), "content": ((UNSPLIT,), False),
}
CODE_TOKENS, DEFAULT_TOKENS = 4096, 2048
