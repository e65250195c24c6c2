"""Names, hosts, paths and texts that the code rules look for."""

from __future__ import annotations

import re

# Names of shells and of commands by what they do.
SHELLS = {"sh", "bash", "zsh", "ksh", "dash", "fish"}
FETCHERS = {"curl", "wget", "aria2c", "http", "httpie"}
NETWORK = {"aria2c", "curl", "ftp", "http", "httpie", "nc", "ncat", "scp", "sftp", "socat", "ssh", "telnet", "wget"}
PROGRAMS = set("bash bun cmake cp dash docker fish git id install ksh make mkdir mv node npm npx perl php pip pnpm powershell pwsh python rm ruby sh uv uvx yarn zsh".split())
READERS, LISTERS = {"cat", "head", "tail", "less", "more"}, {"cat", "head", "tail", "less", "more", "ls", "find"}
INSTALLERS = {("pip", "install"), ("pip3", "install"), ("pipx", "install"), ("npm", "install"), ("yarn", "add"), ("gem", "install")}
NOT_SOURCES = {"-f", "--find-links", "-i", "--index-url", "--extra-index-url", "--registry"}

# Hosts on which anyone can place a file, addresses of instance metadata, credential files and folders of agents.
STAGING = "pastebin.com rentry.co glot.io cdn.discordapp.com transfer.sh 0x0.st termbin.com ix.io sprunge.us file.io gofile.io bashupload.com temp.sh paste.ee hastebin.com dpaste.org dpaste.com ngrok.io ngrok.app ngrok.dev ngrok-free.app ngrok-free.dev trycloudflare.com webhook.site requestbin.net oast.fun interact.sh tmpfiles.org".split()
METADATA = ("169.254.169.254", "metadata.google.internal", "100.100.100.200", "169.254.170.2", "[fd00:ec2::254]")
CREDENTIAL_PATH = re.compile(r"(?i)\.ssh/id_(?:rsa|dsa|ecdsa|ed25519)(?!\.pub)|\.aws/credentials|\.netrc|\.git-credentials|\.docker/config\.json|\.kube/config")
AGENT_PATH = re.compile(r"(?i)\.claude/|\.gemini/|\.cursor/|\.codeium/|\.aider|\.continue/|\.config/github-copilot")
IDENTITY_FILE = re.compile(r"(?i)(?:^|[/\\])(?:CLAUDE\.md|AGENTS\.md|agent\.md|GEMINI\.md|SOUL\.md|MEMORY\.md|IDENTITY\.md|\.cursorrules|\.windsurfrules|\.clinerules|\.roorules|copilot-instructions\.md)$")
PRIORITY_TEXT = re.compile(
    r"(?is)always\s+(?:obey|follow|prioriti[sz]e)|never\s+(?:reveal|disclose|remove)|do\s+not\s+(?:reveal|disclose|mention|remove)|(?:hidden|concealed)\s+(?:rule|instruction|directive|content)|(?:hide|conceal)\s+(?:this|the)\s+(?:rule|instruction|directive|content)|secretly|without\s+(?:telling|notifying)|higher\s+priority|(?:ignore|override)\s+(?:other|prior|previous)\s+instructions?|(?:load|follow)\s+(?:this|it)\s+(?:on|every)\s+(?:startup|session)"
)
PAYLOAD = re.compile(r"(?is)(?:curl|wget)[^\n]*https?://[^\n]*\|\s*(?:ba)?sh|(?<![A-Za-z0-9_.-])(?:eval|(?:ba)?sh\s+-c)\s+[\"']?\$\(\s*(?:curl|wget)\b[^)\n]*https?://[^)\n]+\)|(?<![A-Za-z0-9_.-])powershell(?:\.exe)?\b[^\n;&|]*[ \t]-enc(?:odedcommand)?\b[ \t]+\S+")
STARTUP_FILE = re.compile(r"(?i)(?:^|[/\\])(?:\.(?:bashrc|zshrc|zshenv|zprofile|profile|bash_profile|bash_login)|\.config[/\\]fish[/\\]config\.fish|Documents[/\\](?:WindowsPowerShell|PowerShell)[/\\](?:Microsoft\.)?PowerShell_profile\.ps1)$")
CRON_FILE = re.compile(r"^/etc/cron(?:tab|\.d/[A-Za-z0-9_-]+)$")
LAUNCH_FILE = re.compile(r"(?i)(?:Library/LaunchAgents|Library/LaunchDaemons)/[^/\\]+\.plist$")
UNIT_FILE = re.compile(r"(?i)(?:\.config/systemd/user|/etc/systemd/system)/.*\.service$")
HOOK_FILE = re.compile(r"(?i)\.git[/\\]hooks[/\\](?:applypatch-msg|pre-applypatch|post-applypatch|pre-commit|pre-merge-commit|prepare-commit-msg|commit-msg|post-commit|pre-rebase|post-checkout|post-merge|pre-push|pre-receive|update|post-receive|post-update|push-to-checkout|pre-auto-gc|post-rewrite|sendemail-validate|fsmonitor-watchman|post-index-change)$")
AUTOSTART_FILE = re.compile(r"(?i)\.config[/\\]autostart[/\\][^/\\]+\.desktop$")


def staging_host(url: str) -> bool:
    m = re.search(r"(?i)https?://(?:[^/@]+@)?([^/:?#\s\"']+)", url)
    host = m[1].lower() if m else ""
    return any(host == h or host.endswith("." + h) for h in STAGING)


def metadata_host(url: str) -> bool:
    m = re.match(r"(?i)^[\"']?(?:https?://)?(?:[^/@]+@)?(\[[^\]]+\]|[^/:?#\s\"']+)", url)
    return bool(m) and m[1].lower() in METADATA
