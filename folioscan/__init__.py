"""Quality audits of prompt, code and configuration files as Spark jobs."""
