"""Sources and sinks: board files, alert mails, seeds, table writers."""
