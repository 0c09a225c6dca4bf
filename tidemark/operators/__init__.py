"""DataFrame -> DataFrame operators over keyed time series."""
