"""What a finding means and what to do about it, by rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CODE = "Read the code around this line before anything of this repository is run."
HOSTS = "Find out who owns the host, and whether the project needs it at all."
LOCK = "Delete the lockfile, install from the registry you trust and compare."
EDITOR = "Open the folder in restricted mode until you have read this file."
DEPENDENCY = "Look the package up in the registry before you install anything."
ACCOUNT = "Weigh it with other findings; by itself it says little."
NOTE = "Nothing to do unless other findings point the same way."

EXPLANATIONS: dict[str, tuple[str, str]] = {
    "remote-code-execution": ("Text that arrives at run time is handed to the interpreter, so whoever sends it decides what runs here.", CODE),
    "eval-decoded-blob": ("A decoded text is evaluated at once, which keeps the real program out of sight of a reader.", CODE),
    "string-concat-api-hiding": ("The name of a powerful interface is put together from pieces so that a search does not find it.", CODE),
    "env-dump-exfiltration": ("The whole environment, with every token in it, is turned into a message that can be sent away.", "Treat tokens of this environment as leaked if it has already run."),
    "c2-port-fingerprint": ("A bare address with a port that control servers of known campaigns have used.", HOSTS),
    "beavertail-c2-paths": ("Paths of requests as the loaders of a known campaign make them to their server.", HOSTS),
    "backdoor-command-handlers": ("Several handlers carry the names that a known remote control tool gives its commands.", CODE),
    "python-download-execute": ("Python code is fetched from the network and executed without being looked at.", CODE),
    "ssh-backdoor": ("A key is added to those that may log in, or stored secrets are dumped from this machine.", "Compare your authorized keys with those you know."),
    "powershell-encoded-command": ("A shell command is passed in encoded form, which serves to keep it from being read.", "Decode the argument and read it; do not run it."),
    "windows-lolbin-download": ("A tool that the system brings along is used to fetch and start something from the network.", CODE),
    "macos-password-phish": ("A dialog with a hidden answer asks the user for a password, outside of the system's own prompts.", "Do not type a password into it."),
    "remote-desktop-rat": ("A remote control program is installed or started without asking anyone at the screen.", CODE),
    "startup-persistence": ("Something is arranged to start again by itself after the next login or boot.", "Look at what would be started and remove the entry."),
    "exfil-sink": ("Data can be sent to a public collection point that anyone can open without a name.", HOSTS),
    "tunneling-infra": ("A tunnel gives a machine behind a firewall a public address for others to call.", HOSTS),
    "throwaway-host-c2": ("A free host of a kind that is changed every few days answers with instructions.", HOSTS),
    "dead-drop-resolver": ("The next address is looked up in a public document, so that it can be changed after delivery.", HOSTS),
    "sandbox-evasion": ("The program asks whether it runs in a virtual machine, as malware does before it acts.", CODE),
    "obfuscator-io": ("The shape of code that an obfuscator leaves, in which names and flow are hidden.", "Ask for the source that this was made from."),
    "stealer-file-globbing": ("Files are searched for by the names that wallets and recovery phrases have.", CODE),
    "spyware-dependency": ("A library that records keys or the screen is loaded by a project that shows no need for it.", DEPENDENCY),
    "wallet-extension-id": ("The exact number of a wallet extension stands in the code, which its data folder is found by.", CODE),
    "wallet-file-access": ("A file of a wallet, a browser's secrets or a private key is named where it could be read.", CODE),
    "single-line-blob": ("Nearly all of the file is one very long line, which no one reads in a review.", "Open it with a formatter, or ask for its source."),
    "encoded-blob-density": ("A large part of the file is encoded data whose meaning cannot be seen.", "Decode a part of it to see what it is."),
    "payload-in-config": ("A build configuration, which runs with every build, holds one of the findings above.", "Do not start the build or the editor's preview."),
    "pyproject-custom-backend": ("The build runs a backend of its own choice, so installing executes code of this repository.", "Read the backend before you install."),
    "pyproject-backend-path": ("The build backend is taken from a folder of this repository and runs at installation.", "Read that folder before you install."),
    "go-generate-exec": ("A generate directive starts a shell or a download when code is generated.", "Read the directive before you generate code."),
    "gradle-insecure-repo": ("Dependencies come over plain http, where anyone on the way can replace them.", "Change the address to https."),
    "maven-insecure-repo": ("Dependencies come over plain http, where anyone on the way can replace them.", "Change the address to https."),
    "workflow-pwn-request": ("A workflow with the rights of the main branch checks out and may run code of a stranger.", "Do not enable the workflow in your fork."),
    "workflow-self-hosted-runner": ("A workflow asks for a machine of your own, on which jobs of others would then run.", "Register no runner for this repository."),
    "npmrc-committed-token": ("A token for the registry is part of the repository, for everyone to use or to follow.", "Tell the owner to revoke the token."),
    "npmrc-registry-override": ("Packages are taken from another registry than the usual one, which can answer as it likes.", LOCK),
    "dockerfile-remote-add": ("The image adds a file straight from the network, without a digest to check it by.", "Pin the file by digest, or do not build the image."),
    "vscode-terminal-env": ("The editor's settings change the environment of every terminal opened in this folder.", EDITOR),
    "readme-install-first": ("The read-me urges to install and start at once, before it says what the project is.", NOTE),
    "unicode-tag-smuggling": ("Invisible tag characters carry text that a reader cannot see but a program can.", "Show the bytes of the line and read them."),
    "private-use-steganography": ("Characters without a shape, in long runs, can hold a program that no one sees.", "Show the bytes of the line and read them."),
    "homoglyph-url": ("An address has letters of another script that look like the ones of a known host.", HOSTS),
    "requirements-custom-index": ("Packages are taken from another index than the usual one, which can answer as it likes.", DEPENDENCY),
    "requirements-url-dependency": ("A dependency comes from an address and not from the index, so no one else has checked it.", DEPENDENCY),
    "yarnrc-yarnpath": ("The package manager itself is replaced by a file of this repository at the first call.", "Call the package manager outside this folder only."),
    "agent-instruction-file": ("A coding assistant reads this file as orders, so it acts on what the author wrote.", "Read it in full before an assistant opens this folder."),
    "known-malicious-package": ("A dependency bears a name that has been removed from the registry for malware.", DEPENDENCY),
    "scope-confusion": ("The scope of a dependency differs from a well known one by a single letter.", DEPENDENCY),
    "typosquat-dependency": ("The name of a dependency differs from a well known one by a single letter.", DEPENDENCY),
    "lockfile-off-registry": ("The lockfile takes a package from a host that is not a registry.", LOCK),
    "lockfile-git-dependency": ("The lockfile takes a package from a repository, so that it can change without a release.", LOCK),
    "lockfile-insecure-registry-url": ("The lockfile names the registry by plain http, where anyone on the way can answer.", LOCK),
    "lockfile-manifest-mismatch": ("The manifest asks for a release, but the lockfile installs from a repository instead.", LOCK),
    "transitive-install-script": ("A package that no one asked for by name runs a script when it is installed.", DEPENDENCY),
    "new-account": ("The account was opened only weeks ago, as accounts made for one campaign are.", ACCOUNT),
    "single-repo-account": ("The account has hardly anything but this repository to its name.", ACCOUNT),
    "empty-org": ("The organisation shows no members, so no one stands behind the repository by name.", ACCOUNT),
    "repo-is-fork": ("The repository is a copy of another one, so known code may hide a small change.", "Compare it with the repository that it was copied from."),
    "commit-burst": ("All commits were made within a day, so the history tells nothing of how it grew.", ACCOUNT),
    "author-mismatch": ("No commit bears a name that goes with the owner of the account.", ACCOUNT),
    "vscode-autorun-task": ("Opening the folder in the editor starts this task; no key has to be pressed for it.", EDITOR),
    "vscode-tool-path-hijack": ("A setting makes the editor run a file of the repository in place of a tool that you trust.", EDITOR),
    "devcontainer-initialize-command": ("The command runs on your own machine, outside of the container that is made afterwards.", EDITOR),
    "devcontainer-dangerous-hook": ("The container loads code from elsewhere and runs it as soon as it starts.", EDITOR),
    "unparseable-autorun-config": ("A file that starts things by itself could not be read, so nobody knows what it starts.", EDITOR),
    "mcp-server-autostart": ("An editor with an assistant starts these servers by itself when the folder is opened.", EDITOR),
    "agent-hook-autorun": ("A coding assistant runs these commands on its own while it works in the folder.", EDITOR),
    "direnv-envrc": ("The file is run by the shell whenever someone enters the folder, if direnv is in use.", "Read the file before you allow it for this folder."),
    "pnpm-install-hook": ("The file is run by the package manager during every install, before anything can be looked at.", DEPENDENCY),
    "composer-install-script": ("A script of the manifest is run by the package manager when packages are installed.", DEPENDENCY),
    "makefile-remote-exec": ("Building fetches a script from the network and runs it with your rights.", "Fetch the address yourself and read what it serves; do not build before."),
    "makefile-obfuscated-command": ("A recipe decodes or evaluates text, so its commands cannot be read where they stand.", CODE),
    "dockerfile-remote-exec": ("Building the image fetches a script from the network and runs it.", "Fetch the address yourself and read what it serves; do not build before."),
    "compose-remote-exec": ("Starting the services fetches a script from the network and runs it.", "Fetch the address yourself and read what it serves; start nothing before."),
    "workflow-remote-script": ("The automation fetches a script from the network and runs it on the machines of the provider.", NOTE),
    "workflow-secret-exfiltration": ("A secret of the automation is sent to a host that it is not known to belong to.", "Add no secret to a copy of this repository before you know that host."),
    "broken-package-json": ("The manifest cannot be read, so its scripts and packages were not looked at.", DEPENDENCY),
    "lifecycle-script": ("The package manager runs this script by itself when packages are installed.", "Read the script, and every file that it starts, before you install anything."),
    "dangerous-npm-script": ("The script loads or evaluates code when someone runs it by its name.", CODE),
    "surveillance-dependency": ("The package records the screen or the keyboard, or moves the mouse in your place.", DEPENDENCY),
    "npm-alias-mismatch": ("A name that everybody knows stands for another package, which is what will be installed.", DEPENDENCY),
    "manifest-non-registry-dependency": ("The package comes from an address of its own, where it can change without a new version.", DEPENDENCY),
    "override-redirect": ("A package that others ask for is replaced by one from another address, deep in the tree.", DEPENDENCY),
    "native-build-at-install": ("Native code is compiled, and its build scripts run, when packages are installed.", DEPENDENCY),
    "bin-command-shadowing": ("The package installs a program with the name of a command that you type every day.", DEPENDENCY),
    "odd-dependency-mix": ("A project for the browser brings along what servers are made of, which is unusual.", DEPENDENCY),
    "unparseable-lockfile": ("The lockfile cannot be read, so nobody knows where its packages come from.", LOCK),
    "invisible-characters": ("A character that shows nothing splits a word, so two names look like one.", "Look at the bytes of this line before you trust what it seems to say."),
    "bidi-override": ("Controls of direction make the line appear in another order than it is run in.", "Look at the bytes of this line before you trust what it seems to say."),
    "homoglyph-identifier": ("A word mixes letters of two alphabets that look alike, so two names can look like one.", CODE),
    "high-entropy-literal": ("A long text without any structure stands in the code, as packed or encrypted data does.", CODE),
    "lure-theme": ("The subject is one that fake job offers like to use, such as wallets or trading.", ACCOUNT),
}
OTHER = ("This rule reports a shape that has been seen in malicious repositories.", CODE)


def explained(findings: DataFrame) -> DataFrame:
    """findings with why and next."""

    def column(k: int) -> Column:
        texts = F.create_map(*(F.lit(x) for i, own in EXPLANATIONS.items() for x in (i, own[k])))
        return F.coalesce(F.try_element_at(texts, F.col("id")), F.lit(OTHER[k]))

    return findings.withColumn("why", column(0)).withColumn("next", column(1))
